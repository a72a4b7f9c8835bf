"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of any two texts
sample the same hashes: the sketch of a union is the union of the sketches, and the share of the smaller
sketch found in the other estimates containment, however unequal the texts are. Texts that have few hashes below the
fraction keep their smallest ones up to a fixed number; two sketches are compared up to the place where both are whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One hash in so many is kept.
SCALE = 8
#: Hashes that a sketch has at least, unless the text has fewer shingles.
LEAST = 128
_LOWEST = -(1 << 63)


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """Hashes of all word shingles; a text with fewer words has one of them all, without words none."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        return F.when(n >= size, full).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(hashes, shingles)


def _cut(hashes: Column, scale: int, least: int) -> Column:
    """Of sorted distinct hashes those below 1/scale of the range, or the smallest ``least`` if that is more."""
    below = F.filter(hashes, lambda x: x < F.lit(_LOWEST + (1 << 64) // scale))
    return _let(below, lambda low: F.when(F.size(low) >= least, low).otherwise(F.slice(hashes, 1, least)))


def sketch(text: Column, size: int = 5, scale: int = SCALE, least: int = LEAST) -> Column:
    """Sorted distinct hashes below 1/scale of the range, and the smallest ``least`` in any case."""
    return _let(F.array_sort(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit("")), size))), lambda h: _cut(h, scale, least))


def merged(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of two texts' shingles together."""
    return _let(F.array_sort(F.array_union(a, b)), lambda h: _cut(h, scale, least))


def _whole_to(a: Column, scale: int, least: int) -> Column:
    """Up to which hash a sketch has all that its text has."""
    last = F.when(F.size(a) < least, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(a, -1), F.lit(_LOWEST + (1 << 64) // scale - 1)))
    return F.when(F.size(a) > 0, last).otherwise(F.lit((1 << 63) - 1))


def containment(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Share of the smaller sketch that is in the other, up to where both are whole; two empty ones are alike, an empty and another are not."""

    def shared(s: Column) -> Column:
        small = F.least(F.size(s["a"]), F.size(s["b"]))
        return F.when(small > 0, F.size(F.array_intersect(s["a"], s["b"])) / small).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.lit(0.0))

    def cut(to: Column) -> Column:
        return _let(F.struct(F.filter(a, lambda x: x <= to).alias("a"), F.filter(b, lambda x: x <= to).alias("b")), shared)

    return _let(F.least(_whole_to(a, scale, least), _whole_to(b, scale, least)), cut)


def as_text(a: Column) -> Column:
    """16 hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _range_of(id_col: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the id: first among every n-th, then among those that follow it."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    literal = lambda v: F.array(*[F.lit(int(x)).cast("long") for x in v])
    below = lambda a: F.size(F.filter(a, lambda x: x <= id_col))
    coarse = F.greatest(below(literal(bounds[::step])) - 1, F.lit(0)) * step
    return F.coalesce(coarse + below(F.slice(literal(bounds), coarse + 1, step)), F.lit(0))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, place, span, tail): rows dealt to ranges of ids, each range ending with the first row of the next.

    So every row's follower is in its own range. Ranges come from approximate percentiles: one number and one first
    id for each range reach the driver. The rows are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / parts for k in range(1, parts)] or [0.5]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", cuts, 10000).alias("b")).first()["b"] or []))
    ranged = rows.withColumn("span", _range_of(F.col("doc_id"), bounds))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("mark"))
    firsts = sorted(ranged.groupBy("span").agg(F.min(order).alias("first")).collect(), key=lambda r: r["span"])
    tails = [(firsts[(k + 1) % len(firsts)]["first"], r["span"]) for k, r in enumerate(firsts)]
    ends = spark.createDataFrame([(f["doc_id"], f["mark"], span) for f, span in tails], "e_id long, e_mark long, e_span int")
    marked = ranged.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.xxhash64("text") == F.col("e_mark")), "left")
    places = F.array(F.struct(F.col("span"), F.lit(0).alias("tail")), F.struct(F.col("e_span").alias("span"), F.lit(1).alias("tail")))
    return marked.select("doc_id", "text", F.explode(F.filter(places, lambda p: p["span"].isNotNull())).alias("p")).select("doc_id", "text", "p.span", "p.tail")


def edited_report(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next document by doc_id
    (after the last one comes the first). Null texts count as empty. Rows of one id follow each other by text hash; a
    null id comes first. An empty table gives no rows. Other columns are ignored.
    """
    by = Window.partitionBy("span").orderBy("tail", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    rows = with_next(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    n = F.char_length("text")
    rows = rows.withColumn("next", F.coalesce(F.lead("text").over(by), F.lit("")))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half)))
    rows = rows.select("doc_id", "span", "tail", F.xxhash64("text").alias("mark"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other"))
    rows = rows.withColumn("after", F.lead("own").over(Window.partitionBy("span").orderBy("tail", F.asc_nulls_first("doc_id"), "mark"))).where("tail = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), containment(F.col("own"), F.col("other")).alias("near_edited"), containment(F.col("own"), F.col("after")).alias("near_next"))
