"""Penalised change points of daily series, with Spark's higher-order functions only.

A series is cut into segments of a least length so that the costs of the segments plus a penalty for each cut are
smallest. ``aggregate`` folds the days of a series with an array of states, one for each prefix: best cost, number of
segments and the place where the last segment begins. The states are walked back and the segments exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the registered query: days of a segment at least, and the price of a cut.
LEAST_DAYS, PENALTY = 14, 40_000
#: Series whose products stay below this are counted in 64 bits, others in decimals of 38 digits; both are exact.
_NARROW = 4.0e18
_WIDE = "decimal(38,0)"
#: More than the segments of any series; the best cost and the number of segments share one number.
_PARTS = 1 << 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def daily_totals(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """One row per key: ``key``, ``first_day`` (days since 1970) and ``days``, the daily sums with 0 for days without rows.

    Rows without a value or a time are left out; rows without a key are a series of their own. Sums are made by key
    and day and then gathered by key, each with partial results before its shuffle, so a key with a third of all rows
    sends one row for each day and task.
    """
    taken = rows.where(F.col(value).isNotNull() & F.col(at).isNotNull())
    sums = taken.groupBy(F.col(key).alias("key"), F.unix_date(F.to_date(at)).cast("long").alias("day")).agg(F.sum(F.col(value).cast("long")).alias("total"))
    lists = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", "total"))).alias("found"))
    gap = lambda x, i: F.coalesce(F.get("found", i + 1)["day"] - x["day"] - 1, F.lit(0)).cast("int")
    filled = F.transform("found", lambda x, i: F.concat(F.array(x["total"]), F.array_repeat(F.lit(0).cast("long"), gap(x, i))))
    return lists.select("key", F.get("found", F.lit(0))["day"].alias("first_day"), F.flatten(filled).alias("days"))


def _spread(n: Column, total: Column, squares: Column, wide: bool) -> Column:
    """1 and the variance rounded down, of exact integers."""
    above, below = n * squares - total * total, n * n
    if not wide:
        return F.call_function("div", above, below) + 1
    below = below.cast(_WIDE)  # div would give 64 bits, and wrap
    return (((above - above % below) / below).cast(_WIDE) + 1).cast(_WIDE)


def _cost(n: Column, spread: Column) -> Column:
    return n * F.floor(F.lit(1000.0) * F.ln(spread.cast("double")))


def _running(values: Column, kind: str) -> Column:
    """0 and the running sums of an array."""
    zero = F.lit(0).cast(kind)
    return F.aggregate(values, F.array(zero), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def _segments(totals: Column, squares: Column, least: Column, penalty: int, wide: bool) -> Column:
    """Segments of one series, as an array of structs, from the running sums of its days and of their squares.

    A state has ``start``, where its last segment begins, and ``order``: the best cost with the penalty of the cut
    that would follow, and the number of segments in the lowest digits, so that the smallest is the best and has the
    fewest segments. Prefixes at which no segment can end keep an order that is never read. A segment has ``least``
    days, so the states of so many days depend on earlier ones only and are added in one step of the fold.
    """
    n_days, cut = F.size(totals) - 1, F.lit(penalty * _PARTS)
    sums = lambda at: (F.get(totals, at).alias("total"), F.get(squares, at).alias("squares"))
    zero = F.array(F.struct(F.lit(0).cast("long").alias("order"), F.lit(0).alias("start"), *sums(F.lit(0))))

    def step(states: Column, first: Column) -> Column:
        def new(now: Column) -> Column:
            at = now["at"]

            def through(n: Column, before: Column) -> Column:
                return before["order"] + _cost(n, _spread(n, now["total"] - before["total"], now["squares"] - before["squares"], wide)) * _PARTS

            whole = F.array(through(at.cast("long"), F.get(states, F.lit(0))))
            # segments from each place that leaves enough days on both sides
            later = F.zip_with(F.sequence((at - least).cast("long"), least.cast("long"), F.lit(-1).cast("long")), F.slice(states, least + 1, at - least - least + 1), through)
            orders = F.when(at < least + least, whole).otherwise(F.concat(whole, later))
            ends = (at >= least) & ((n_days - at >= least) | (at == n_days))
            # of equal ones the first has the earliest start
            chosen = F.when(ends, _let(orders, lambda o: _let(F.array_min(o), lambda m: F.struct((m + 1 + cut).alias("order"), F.array_position(o, m).cast("int").alias("place")))))
            return _let(chosen, lambda c: F.struct(F.coalesce(c["order"], F.lit(0)).alias("order"), F.when(c["place"] > 1, least + c["place"] - 2).otherwise(F.lit(0)).alias("start"), now["total"].alias("total"), now["squares"].alias("squares")))

        block = F.transform(F.sequence(first, F.least(first + least - 1, n_days)), lambda at: F.struct(at.alias("at"), *sums(at)))
        return F.concat(states, F.transform(block, new))

    def walked(states: Column) -> Column:
        order = F.element_at(states, -1)["order"] - cut
        parts = (order % _PARTS).cast("int")
        back = lambda starts, _: F.concat(F.array(F.get(states, F.get(starts, F.lit(0)))["start"]), starts)
        starts = F.aggregate(F.sequence(F.lit(1), parts), F.array(n_days), back)

        def segment(start: Column, i: Column, end: Column) -> Column:
            n = (end - start).cast("long")
            total = F.get(totals, end) - F.get(totals, start)
            spread = _spread(n, total, F.get(squares, end) - F.get(squares, start), wide).cast("long")
            return F.struct((i + 1).alias("segment_no"), start.alias("start"), n.alias("n_days"), total.cast("long").alias("total"), spread.alias("spread"), _cost(n, spread).alias("cost"), parts.cast("long").alias("n_segments"), F.call_function("div", order, F.lit(_PARTS)).alias("best_cost"))

        return _let(starts, lambda found: F.transform(F.slice(found, F.lit(1), parts), lambda start, i: segment(start, i, F.get(found, i + 1))))

    return _let(F.aggregate(F.sequence(F.lit(1), n_days, least), zero, step), walked)


def change_points(series: DataFrame, least: int = LEAST_DAYS, penalty: int = PENALTY) -> DataFrame:
    """Segments of series given as ``key``, ``first_day``, ``days`` (array of longs without nulls).

    One row per segment: key, segment_no (from 1), first_day, n_days, total, spread (1 and the variance, rounded
    down), cost (n_days times the thousandfold logarithm of the spread, rounded down), n_segments and best_cost of
    the whole series, penalties included. A segment has ``least`` days or more; a shorter series is one segment.
    Equal costs: fewest segments, then the earliest start of the last segment, of the one before, and so on. Empty
    arrays give no rows. The days are moved by the middle of their range first, which leaves the variance as it is.
    A spread of more than 64 bits is an error.
    A series of n days takes about n * n / 2 steps; it has less than a million segments, and ``penalty`` times its days
    stays below 8e12.
    """
    n = F.size("days")
    ranged = series.where(n > 0).withColumn("middle", F.call_function("div", F.array_min("days") + F.array_max("days"), F.lit(2)))
    half = (F.array_max("days").cast("double") - F.array_min("days").cast("double")) / 2 + 1
    moved = ranged.select("key", "first_day", "middle", F.transform("days", lambda x: x - F.col("middle")).alias("moved"), (n.cast("double") * n.cast("double") * half * half < _NARROW).alias("narrow"))
    sums = moved.select("*", _running(F.col("moved"), "long").alias("totals"), F.when(F.col("narrow"), _running(F.transform("moved", lambda x: x * x), "long")).alias("squares"), F.when(~F.col("narrow"), _running(F.transform("moved", lambda x: x.cast(_WIDE) * x), _WIDE)).alias("wide"))
    shortest = F.least(F.size("moved"), F.lit(least))
    cut = lambda kind, squares: _segments(F.transform("totals", lambda x: x.cast(kind)) if kind == _WIDE else F.col("totals"), F.col(squares), shortest, penalty, kind == _WIDE)
    each = sums.select("key", "first_day", "middle", F.explode(F.when(F.col("narrow"), cut("long", "squares")).otherwise(cut(_WIDE, "wide"))).alias("s"))
    return each.select(
        "key", F.col("s.segment_no").alias("segment_no"), (F.col("first_day") + F.col("s.start")).alias("first_day"), F.col("s.n_days").alias("n_days"),
        (F.col("s.total") + F.col("s.n_days") * F.col("middle")).alias("total"), F.col("s.spread").alias("spread"), F.col("s.cost").alias("cost"), F.col("s.n_segments").alias("n_segments"), F.col("s.best_cost").alias("best_cost"),
    )


def report(lines: DataFrame) -> DataFrame:
    """Segments of each vendor's daily quantity."""
    return change_points(daily_totals(lines, "vendor_id", "shipped_at", "quantity")).withColumnRenamed("key", "vendor_id")
