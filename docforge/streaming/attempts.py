"""A log of attempts as a stream: the final attempt of each case, kept in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampNTZType, TimestampType

from docforge.operators.evaluation import final_attempts

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Folders of the batches of a table that is written by batch.
_BATCH = "_written_in"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Decisive(StatefulProcessor):
    """Of each case the first attempt and the last success; an attempt goes out when it becomes one of the two.

    A case that was silent for ``quiet`` milliseconds of event time is closed and its state cleared. Should it speak
    again it starts anew; what went out before is still in the table, so the final attempt is found all the same.
    """

    def __init__(self, schema: StructType, ok: str, sequence: list[str], ts: str, quiet: int):
        self.ok, self.sequence, self.ts, self.quiet = ok, sequence, ts, quiet
        # the state is the places of both in the order, and whether there was a success; times are kept as microseconds
        kind = lambda c: LongType() if isinstance(schema[c].dataType, (TimestampType, TimestampNTZType)) else schema[c].dataType
        self.schema = StructType([StructField(f"{side}{k}", kind(c)) for side in ("first", "last") for k, c in enumerate(sequence)] + [StructField("succeeded", BooleanType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getValueState("places", self.schema)

    def _place(self, row: Row) -> tuple:
        number = lambda v: (v.replace(tzinfo=v.tzinfo or timezone.utc) - _EPOCH) // timedelta(microseconds=1) if isinstance(v, datetime) else v
        return tuple(number(row[c]) for c in self.sequence)

    @staticmethod
    def _order(place: tuple) -> list[tuple]:
        return [(v is not None, *([] if v is None else [v])) for v in place]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, n = self.places.get(), len(self.sequence)
        first, last = (tuple(held[:n]), tuple(held[n : 2 * n]) if held[2 * n] else None) if held else (None, None)
        new: dict[str, Row] = {}
        for row in rows:
            place = self._place(row)
            if first is None or self._order(place) < self._order(first):
                first, new["first"] = place, row
            if row[self.ok] and (last is None or self._order(place) > self._order(last)):
                last, new["last"] = place, row
        if new:
            self.places.update((*first, *(last or (None,) * n), last is not None))
        out = [new[k] for k in ("first", "last") if k in new and not (k == "last" and new[k] is new.get("first"))]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.quiet)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.places.clear()
        return iter(())

    def close(self) -> None:
        pass


def follow(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, case: str, ok: str, sequence: list[str], ts: str | None = None, late: str = "1 hour", quiet_ms: int = 24 * 3_600_000, files: int | None = None):
    """Start a query that adds to ``table`` the attempts that decide: first attempts and last successes of each case.

    Each case has two attempts in the state store, so a batch costs what is new, not what was there before, and a restart
    on the same checkpoint goes on where it was. The order of attempts is that of ``sequence`` (nulls first), not of
    arrival. Without ``ts`` all cases stay and no row is late: the two are streaming aggregates, put together in each
    task before rows are shuffled, and a batch writes those of the cases that it has rows of to a folder of its own, anew
    if it is run again. With ``ts`` rows older than the watermark (``late`` behind the latest) are dropped, and cases
    silent for ``quiet_ms`` beyond it are closed by a timer, so the state holds the places of open cases only. ``files``:
    files of a batch at most. Rows without a case are one case.
    """
    spark.conf.set(PROVIDER, ROCKSDB)
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    stream = reader.parquet(source)
    shape = stream.schema
    if ts:
        decided = stream.withWatermark(ts, late).groupBy(case).transformWithState(_Decisive(shape, ok, sequence, ts, quiet_ms), shape, outputMode="Append", timeMode="EventTime")
        return decided.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    row, place = F.struct(*shape.names), F.struct(*sequence)
    both = stream.groupBy(F.col(case).alias("_case")).agg(F.min_by(row, place).alias("_first"), F.max_by(F.when(F.col(ok), row), F.when(F.col(ok), place)).alias("_last"))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.explode(F.array_compact(F.array_distinct(F.array("_first", "_last")))).alias("r")).select("r.*")
        rows.write.mode("overwrite").parquet(f"{table}/{_BATCH}={number}")

    return both.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finals(spark: SparkSession, table: str, schema: str, case: str, ok: str, sequence: list[str]) -> DataFrame:
    """The final attempts of all that was written so far; only attempts that decided once are read."""
    return final_attempts(spark.read.schema(schema).parquet(table).drop(_BATCH), case, ok, sequence)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by time window and kind; works on streams (with a watermark) and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
