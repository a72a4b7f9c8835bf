"""Which names stand in which texts, and which names begin others, by equi-joins of short pieces.

A name stands in a text only if any piece of it does. So names and texts meet by one piece of each name, the one that
fewest names share, and only then are compared. Nothing is compared pair by pair and nothing is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters of a piece; shorter names are pieces themselves.
PIECE = 6
#: Texts are cut in stretches of so many characters first, since finding a place in a text takes steps by that place.
STRETCH = 200
#: Pieces that are looked up within the rows at most; more are joined only.
LITERAL_PIECES = 20_000


def _pieces(text: Column, size: Column | int) -> Column:
    """All distinct pieces of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))).otherwise(F.expr("cast(array() as array<string>)"))


def _looking_up(sizes: list[int], wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                own = {p for n in sizes for a in range(len(text) - n + 1) if (p := text[a : a + n]) in wanted}
                found += own
                rows += [i] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["text_key", "piece"])

    return run


def _cut(texts: DataFrame, key: str, text: str, sizes: list[int], wanted: list[str] | None = None) -> DataFrame:
    """(text_key, piece): the pieces of texts of each of ``sizes``, those ``wanted`` only; work and rows grow with the texts' length."""
    if not sizes:
        return texts.select(F.col(key).alias("text_key"), F.lit("").alias("piece")).limit(0)
    if wanted is not None:
        rows = texts.where(F.length(text) > 0).select(F.col(key).alias("text_key"), F.col(text).alias("s"))
        return rows.mapInArrow(_looking_up(sizes, frozenset(wanted)), StructType([rows.schema["text_key"], StructField("piece", StringType())]))
    # the outer forms keep the optimizer from filtering by a copy of the whole expression
    stretches = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{1,{STRETCH + max(sizes) - 1}}})).{{1,{STRETCH}}}"), F.lit(1))
    rows = texts.where(F.length(text) > 0).select(F.col(key).alias("text_key"), F.explode_outer(stretches).alias("s"))
    parts = F.flatten(F.array(*[_pieces(F.col("s"), n) for n in sizes]))
    return rows.select("text_key", F.explode_outer(parts).alias("piece")).where(F.col("piece").isNotNull())


def _few(pieces: DataFrame) -> list[str] | None:
    """The distinct pieces, if they can be looked up within rows."""
    found = [r[0] for r in pieces.select("piece").distinct().limit(LITERAL_PIECES + 1).collect()]
    return found if len(found) <= LITERAL_PIECES else None


def contained(texts: DataFrame, names: DataFrame, text_key: str, text: str, name_key: str, name: str, piece: int = PIECE) -> DataFrame:
    """(text key, name key) of names that stand in a text, character for character, each pair once.

    Null or empty names and texts meet nothing. A name shorter than ``piece`` meets by all of its characters, so texts
    are cut once for each length of a piece that names have; these are at most ``piece``. Up to ``LITERAL_PIECES`` pieces
    are looked up within the rows, so only pieces that hit are shuffled.
    """
    own = names.where(F.length(name) > 0).select(F.col(name_key).alias("name_key"), F.col(name).alias("name")).distinct()
    cut = own.select("name_key", "name", F.explode(_pieces(F.col("name"), F.least(F.length("name"), F.lit(piece)))).alias("piece"))
    shared = cut.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = cut.join(shared, "piece").groupBy("name_key", "name").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    sizes = sorted(r[0] for r in own.select(F.least(F.length("name"), F.lit(piece))).distinct().collect())
    rows = texts.where(F.length(text) > 0).select(F.col(text_key).alias("text_key"), F.col(text).alias("text"))
    met = _cut(texts, text_key, text, sizes, _few(rarest)).join(rarest, "piece").select("text_key", "name_key", "name").distinct()
    found = met.join(rows, "text_key").where(F.contains("text", "name"))
    return found.select(F.col("text_key").alias(text_key), F.col("name_key").alias(name_key)).distinct()


def touched(texts: DataFrame, names: DataFrame, text_key: str, text: str, name_key: str, name: str, piece: int = PIECE, common: tuple[str, ...] = ()) -> DataFrame:
    """(text key, name key) where any ``piece`` characters in a row of a name stand in a text; pieces with a word of ``common`` or blanks at an end do not count."""
    own = names.select(F.col(name_key).alias("name_key"), F.explode(_pieces(F.col(name), piece)).alias("piece")).where(F.trim("piece") == F.col("piece"))
    for word in common:
        own = own.where(~F.contains("piece", F.lit(word)))
    cut = _cut(texts, text_key, text, [piece])
    return cut.join(own, "piece").select(F.col("text_key").alias(text_key), F.col("name_key").alias(name_key)).distinct()


#: Rows of one beginning that meet in a task at most; more are dealt by their key.
TOGETHER = 1000


def beginning(longer: DataFrame, shorter: DataFrame, long_key: str, long: str, short_key: str, short: str) -> DataFrame:
    """(long key, short key): strings that begin with another one, each pair once; equal ones count, null and empty ones meet nothing.

    Of each long string only the beginnings of lengths that short ones have are joined. Both sides are shuffled, and
    short strings with more than ``TOGETHER`` keys are dealt over several tasks. Pairs are unique as they come but for
    keys with several short strings, so only those are made distinct.
    """
    few = shorter.where(F.length(short) > 0).select(F.col(short_key).alias("short_key"), F.col(short).alias("start")).distinct()
    sizes = F.array(*[F.lit(r[0]) for r in few.select(F.length("start").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")
    rows = longer.where(F.col(long).isNotNull()).select(F.col(long_key).alias("long_key"), F.col(long).alias("long"), F.explode(F.filter(sizes, lambda n: n <= F.length(long))).alias("n"))
    starts = rows.select("long_key", F.substring(F.col("long"), F.lit(1), F.col("n")).alias("start")).distinct()
    shares = few.groupBy("start").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("shares"))
    several = few.groupBy("short_key").agg((F.count("*") > 1).alias("several"))
    own = few.join(several.hint("merge"), "short_key").join(shares.hint("merge"), "start").withColumn("share", F.pmod(F.xxhash64("short_key"), F.col("shares").cast("long")))
    asked = starts.join(shares.hint("merge"), "start").select("long_key", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)).alias("share"))
    met = lambda which: asked.join(own.where(which).hint("merge"), ["start", "share"]).select(F.col("long_key").alias(long_key), F.col("short_key").alias(short_key))
    return met("not several").union(met("several").distinct())
