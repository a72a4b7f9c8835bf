"""Queries on texts, tables and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import candidates, chunking, tables
from docforge.operators.retrieval import tokens
from docforge.plans.common import shared_folder, table
from docforge.plans.registry import query

_NOISE = "\n- 3 -\n-----\nContents ..... 12\n\n\n\nend of <표>"


@query(r"""select doc_id, md5(regexp_replace(array_to_string(list_filter(string_split(text || chr(10) || '- 3 -' || chr(10) || '-----' || chr(10) || 'Contents ..... 12' || chr(10) || chr(10) || chr(10) || chr(10) || 'end of <표>', chr(10)),
  lambda x: not regexp_matches(x, '^.{1,60}?[.․‥…·]{3,}\s*\d{1,4}\s*$|^\s*-\s*\d{1,4}\s*-\s*$|^[\-=~_*◇◆※─━═│┃╌╍]{3,}$')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) as digest from documents""")
def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.remove_noise_lines(F.concat("text", F.lit(_NOISE)))).alias("digest"))


@query("select doc_id, length(text)::bigint as n from documents")
def placeholder_lines(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat("text", F.lit("\n<그림>"))
    return table(spark, d, "documents").select("doc_id", F.length(T.without_lines(marked, T.IMAGE_MARK)).cast("long").alias("n"))


@query("select case when length(text) < 300 then 'scanned' when length(text) < 1000 then 'short_text' else 'plain_text' end as doc_type, 'low' as confidence, count(*) as n from documents group by all")
def document_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(T.class_by_length(F.length("text")).alias("c")).groupBy("c.doc_type", "c.confidence").agg(F.count("*").alias("n"))


@query("""select case when doc_id % 4 > 0 and (doc_id % 3) * 2 > doc_id % 4 then 'scanned' when doc_id % 5 >= 3 and length(text) < 2000 then 'table_heavy' when length(text) < 300 then 'scanned' else 'plain_text' end as doc_type, count(*) as n
  from documents group by 1""")
def document_class_parsed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").groupBy(T.class_with_parse(F.length("text"), k % 5, k % 4, k % 3).alias("doc_type")).agg(F.count("*").alias("n"))


@query("select source as origin, case when doc_id % 3 = 0 then 'csv_fallback' else 'raw_parsed' end as source, sum(length(text))::bigint as n from documents group by all")
def merged_texts(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select(F.col("source").alias("origin"), T.merged_text(parsed, F.col("text")).alias("m"))
    return rows.groupBy("origin", "m.source").agg(F.sum(F.length("m.text")).alias("n"))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Lines with bars as tables of one row each."""
    cells = lambda line: F.transform(F.split(line, r" \| "), lambda c: F.struct(c.alias("text"), F.lit(1).alias("colspan"), F.lit(None).cast("string").alias("bg")))
    rows = F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" | "))), cells)
    return table(spark, d, "documents").select("doc_id", "text", rows.alias("cells")).where("size(cells) > 0")


@query(r"""with r as (select doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | ')), lambda line: array_to_string(list_filter(string_split(line, ' | '), lambda c: c <> ''), ' | ')), lambda x: x <> '') as rows from documents)
  select doc_id, md5('[표]' || chr(10) || array_to_string(rows, chr(10))) as digest from r where len(rows) > 0""")
def table_flatten(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d).select("doc_id", F.md5(tables.flat_rows(F.col("cells"))).alias("digest"))


@query("""with r as (select doc_id, text, flatten(list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | ')), lambda line: string_split(line, ' | '))) as cells from documents),
  c as (select doc_id, list_filter(list_transform(cells, lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: x <> '') as cells, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not contains(x, ' | ')), chr(10)), '\\s+', '', 'g') as body from r where len(cells) > 0)
  select doc_id, round(len(list_filter(cells, lambda x: contains(body, x))) / len(cells), 6) as ratio from c""")
def table_repeat_ratio(spark: SparkSession, d: str) -> DataFrame:
    body = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.contains(x, F.lit(" | "))), "\n")
    return _bars(spark, d).select("doc_id", F.round(tables.repeat_ratio(F.col("cells"), body), 6).alias("ratio"))


@query("""select doc_id, doc_id % 3 < 2 as inserted, md5(case when doc_id % 3 = 0 then 'a' || chr(10) || 'T0' || chr(10) || 'b' when doc_id % 3 = 1 then 'T0' || chr(10) || 'x' || chr(10) || 'T1' else '<표>' || chr(10) || 'c' end) as digest from documents""")
def inline_tables(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    docs = table(spark, d, "documents").select("doc_id", F.when(k == 0, "a\n<표>\nb").when(k == 1, "<표>\nx\n<표>").otherwise("<표>\nc").alias("text"))
    flat = docs.select("doc_id", F.explode(F.sequence(F.lit(0), k)).alias("nth")).select("doc_id", F.col("nth").cast("int").alias("nth"), F.concat(F.lit("T"), F.col("nth").cast("string")).alias("table_text"))
    return tables.insert_inline(docs, flat).select("doc_id", "inserted", F.md5("text").alias("digest"))


@query("""select case when doc_id % 4 = 0 then 'timeout' when doc_id % 4 = 1 then 'failed' when doc_id % 4 = 2 then 'none' else 'ok' end as status, count(*) as n, sum(doc_id % 2)::bigint as placeholders from documents group by 1""")
def table_statistics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    rows = table(spark, d, "documents").select(F.when(k == 0, "timeout 90").when(k == 1, "extraction failed").when(k == 2, "no table").otherwise("2 tables").alias("note"), F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit("\n<표>"))).otherwise(F.col("text")).alias("text"))
    return tables.table_statistics(rows)


@query(r"""with s as (select doc_id, text, lower(text) as low from documents), p as (select doc_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: text[i:i + 3] = 'tion')) as place from s where contains(text, 'tion'))
  select doc_id, count(*) as n from p group by doc_id""")
def keyword_snippets(spark: SparkSession, d: str) -> DataFrame:
    found = T.snippets(F.col("text"), F.lit("tion"))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n")).where("n > 0")


@query(r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') as ws from documents), s as (select doc_id, ws, unnest(range(0, len(ws), 100)) as place from w)
  select doc_id, (place // 100)::bigint as nth, md5(array_to_string(ws[place + 1:place + 100], ' ')) as digest from s""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.word_windows(table(spark, d, "documents"), 100).select("doc_id", F.col("nth").cast("long").alias("nth"), F.md5("text").alias("digest"))


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("nested", F.contains(F.col("text"), F.lit(" | ")) | (F.length("text") > 8000))
    return chunking.chunk_documents(docs).select("doc_id", "chunk_id", "strategy", "parent_chunk_id", "nth", F.length("text").alias("n"), F.element_at("metadata", "lang").alias("lang"))


@query("select case when contains(text, ' | ') or length(text) > 8000 then 'nested' else 'recursive' end as strategy, count(*) as n_docs from documents where trim(text) <> '' group by 1")
def chunk_strategies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("nested", F.contains(F.col("text"), F.lit(" | ")) | (F.length("text") > 8000))
    kinds = chunking.chunk_documents(docs).select("doc_id", F.when(F.col("strategy") == "recursive", "recursive").otherwise("nested").alias("strategy")).distinct()
    return kinds.groupBy("strategy").agg(F.count("*").alias("n_docs"))


@query()
def candidate_passages(spark: SparkSession, d: str) -> DataFrame:
    intro = F.concat(F.lit("1. 사업 목적\n아래와 같다.\n담당 부서: TEL: 02-123-4567\n[별지 제1호]\n계약 방법은 협상이다.\n"), "text")
    return candidates.extract(table(spark, d, "documents").select("doc_id", intro.alias("text")))


@query(r"""with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents),
  s as (select doc_id, list_sort(list_distinct(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')))) as grams from t where len(ws) >= 8),
  c as (select grams, min(doc_id) as doc_id, count(*) as copies from s group by 1), g as (select doc_id, unnest(grams) as s from c),
  p as (select a.doc_id as a, b.doc_id as b, count(*) as n from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2)
  select a, b, x.copies as copies_a, y.copies as copies_b, round(n / least(len(x.grams), len(y.grams)), 6) as contained from p join c x on x.doc_id = a join c y on y.doc_id = b where 10 * n >= 9 * least(len(x.grams), len(y.grams))""")
def shingle_containment(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for a table of exclusions: classes of documents with equal shingles, and pairs of classes where one holds nine tenths of the other."""
    return tables_of_contained(table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("ws")))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Shingles are counted in so many parts, one after the other, so that only one part is on disk as shuffle files.
_PARTS = 4


def _grams(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, hashes of words): (doc_id, grams), the sorted distinct hashes of ``size`` consecutive words."""
    factors = np.random.default_rng(8).integers(1 << 62, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        lists = batch.column(1)
        words, starts = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        full = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k, f in enumerate(factors):
            full += words[k : k + len(full)] * f
        for shift, f in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):  # mixed, as sums alone keep the order of low bits
            full = (full ^ (full >> np.uint64(shift))) * np.uint64(f)
        own = [np.unique(full[a : b - size + 1]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
        grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), grams], ["doc_id", "grams"])


def tables_of_contained(words: DataFrame, size: int = 8) -> DataFrame:
    """(a, b, copies_a, copies_b, contained): the smallest ids of two classes, how many documents they have, and the share.

    The smaller set of a pair shares one of its rarest tenth (and one more) with the larger, so only those are looked up.
    Classes and what they share are written once below the shared folder.
    """
    spark = words.sparkSession
    folder = shared_folder(spark, "contained")

    def saved(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        """The table takes the place of the plan, whose shuffle files are removed with the write."""
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode(mode).parquet(f"{folder}/{name}")
        finally:
            spark.conf.set(_CLEANUP, before)
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    hashed = words.where(F.size("ws") >= size).select(F.col("doc_id").cast("long"), F.transform("ws", lambda w: F.xxhash64(w)).alias("ws"))
    sets = hashed.mapInArrow(lambda batches: _grams(batches, size), "doc_id long, grams array<long>")
    # equal sets are told by 128 bits, so the arrays are no keys
    classes = sets.groupBy(F.xxhash64("grams").alias("low"), F.xxhash64(F.reverse("grams")).alias("high")).agg(F.min("doc_id").alias("doc_id"), F.min_by("grams", "doc_id").alias("grams"), F.count("*").alias("copies"))
    classes = saved(classes.select("doc_id", "copies", "grams"), "classes")
    # no set is empty; the outer form keeps the optimizer from filtering the arrays first
    each = classes.select("doc_id", F.size("grams").alias("size"), F.explode_outer("grams").alias("s"))
    for part in range(_PARTS):
        own = each.where(F.pmod("s", F.lit(_PARTS)) == part).withColumn("df", F.count("*").over(Window.partitionBy("s")))
        shared = saved(own.where("df > 1"), "shared", "append")
    # grams of one class alone are the rarest; what of the tenth they leave open is looked up
    alone = F.col("size") - F.count("*").over(Window.partitionBy("doc_id"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "s"))
    asked = shared.withColumn("alone", alone).withColumn("nth", nth).where(F.col("nth") + F.col("alone") <= F.floor(F.col("size") / 10) + 1)
    met = asked.select(F.col("doc_id").alias("x"), F.col("size").alias("n"), "s").join(shared.select(F.col("doc_id").alias("y"), F.col("size").alias("m"), "s"), "s").where("x != y and n <= m")
    pairs = saved(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    side = lambda k: classes.select(F.col("doc_id").alias(k), F.col("grams").alias(f"g{k}"), F.col("copies").alias(f"copies_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.size(F.array_intersect("ga", "gb"))).withColumn("m", F.least(F.size("ga"), F.size("gb")))
    return both.where("10 * n >= 9 * m").select("a", "b", "copies_a", "copies_b", F.round(F.col("n") / F.col("m"), 6).alias("contained"))
