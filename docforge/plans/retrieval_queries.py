"""Queries on rankings: lexical, vector and fused search, expansion, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import chunking, neighbours, term_index
from docforge.operators import retrieval as R
from docforge.plans.common import shared_folder, table
from docforge.plans.registry import query

BM25_SQL = r"""
  dt as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from documents),
  dl as (select doc_id, count(*) as dl from dt group by 1), stats as (select (select count(*) from documents) as n_docs, (select count(*) from dt) / (select count(*) from documents) as avgdl),
  tf as (select doc_id, term, count(*) as tf from dt group by all), df as (select term, count(*) as df from tf group by 1),
  raw as (select term, ln(n_docs - df + 0.5) - ln(df + 0.5) as raw from df, stats), idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
  qt as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from benchmark) group by all),
  bm as (select query_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join tf using (term) join idf using (term) join dl on dl.doc_id = tf.doc_id, stats group by 1, 2),
  bm_ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from bm)
"""


_indexes: dict[tuple[str, str], term_index.TermIndex] = {}


def _index(spark: SparkSession, d: str) -> term_index.TermIndex:
    """The term index of the documents of a folder, written once in a session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _indexes:
        _indexes[at] = term_index.build(table(spark, d, "documents").select("doc_id", "text"), shared_folder(spark, "terms"))
    return _indexes[at]


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, d: str, k: int, floor: float | None = None) -> DataFrame:
    """The k best documents of each question; scores are rounded, so equal texts tie."""
    return term_index.search(_index(spark, d), _questions(spark, d), k, shared_folder(spark, "search"), floor=floor)[0]


@query(f"with {BM25_SQL} select query_id, doc_id, rank, round(score, 4) as score from bm_ranked where rank <= 5 and score > 0")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 5, floor=0.0).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


VECTOR_SQL = """
  e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
  vs as (select q.vec_id as query_id, u.vec_id as doc_id, 2 * list_dot_product(u.v, q.v) - 1 as score from u, u q where q.vec_id % 50 = 0),
  vs_ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from vs)
"""


def _vectors(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return neighbours.nearest(neighbours.candidates(e, asked, k, "vec_id", "embedding", "query_id", "q"), k)


@query(f"with {VECTOR_SQL} select query_id, doc_id, rank, round(score, 5) as score from vs_ranked where rank <= 5")
def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"""with {VECTOR_SQL}, ok as (select v.query_id, v.doc_id, v.score from vs_ranked v join embeddings on vec_id = doc_id where rank <= 20 and label < 3)
  select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from ok qualify rank <= 5""")
def vector_postfilter(spark: SparkSession, d: str) -> DataFrame:
    ranked = _vectors(spark, d, 20)
    allowed = table(spark, d, "embeddings").where("label < 3").select(F.col("vec_id").alias("doc_id"))
    return R.post_filtered(ranked, allowed, 5, "query_id", "doc_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


# Two sides of one fusion: documents by BM25, and documents by the vectors with their ids; a question has the vector with its id.
_SIDES = f"""{BM25_SQL}, e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
  ve as (select item_id as query_id, u.vec_id as doc_id, 2 * list_dot_product(u.v, q.v) - 1 as score from benchmark join u q on q.vec_id = item_id, u where u.vec_id in (select doc_id from documents)),
  ov_ranked as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from ve),
  a as (select query_id, doc_id, case when max(score) over w - min(score) over w < 1e-9 then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as norm from bm_ranked where rank <= 20 window w as (partition by query_id)),
  b as (select query_id, doc_id, case when max(score) over w - min(score) over w < 1e-9 then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as norm from ov_ranked where rank <= 20 window w as (partition by query_id))"""


def _by_vector(spark: SparkSession, d: str, k: int) -> DataFrame:
    e, q = table(spark, d, "embeddings"), table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    own = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = q.join(e, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return neighbours.nearest(neighbours.candidates(own, asked, k, "vec_id", "embedding", "query_id", "q"), k)


@query(f"""with {_SIDES}, f as (select query_id, doc_id, sum(part) as score, string_agg(side, '+' order by side) as matched_by from (select query_id, doc_id, 0.5 * norm as part, 'bm25' as side from a union all select query_id, doc_id, 0.5 * norm, 'vector' from b) group by 1, 2)
  select query_id, doc_id, matched_by, round(score, 4) as score from f qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 5""")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = R.fuse(_by_vector(spark, d, R.CANDIDATES), _bm25(spark, d, R.CANDIDATES)).withColumn("score", F.round("score", 9))
    return R.top_k(fused, 5).select("query_id", "doc_id", "matched_by", F.round("score", 4).alias("score"))


CHUNKS_SQL = r"""w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') as ws from documents),
  c as (select doc_id, (place // 50) as nth, array_to_string(ws[place + 1:place + 50], ' ') as text from (select doc_id, ws, unnest(range(0, len(ws), 50)) as place from w))"""
_WINDOWS = rf"""{CHUNKS_SQL},
  h as (select *, ((doc_id * 7919 + nth * 104729) % 10007) * 10000000000 + doc_id * 1000 + nth as rank, (doc_id * 7 + nth) % 10 as query_id from c)"""


@query(f"""with {_WINDOWS}, q as (select query_id, doc_id, nth // 4 as p, min(rank) as rank from h group by 1, 2, 3)
  select query_id, doc_id, p::bigint as parent, rank from q""")
def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 50 words as children of 200: of each parent the first hit stays."""
    c = chunking.word_windows(table(spark, d, "documents"), 50)
    parent = F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("-"), F.floor(F.col("nth") / 4).cast("string"))
    c = c.select(F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), F.col("nth").cast("string")).alias("chunk_id"), parent.alias("parent_chunk_id"), "doc_id", "nth", "text")
    place = ((F.col("doc_id") * 7919 + F.col("nth") * 104729) % 10007) * 10000000000 + F.col("doc_id") * 1000 + F.col("nth")
    hits = c.select("chunk_id", "doc_id", "nth", place.cast("long").alias("rank"), ((F.col("doc_id") * 7 + F.col("nth")) % 10).alias("query_id"))
    parents = c.select(F.col("parent_chunk_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_chunk_id"), "text").dropDuplicates(["chunk_id"])
    out = R.expand_to_parent(hits, c.select("chunk_id", "parent_chunk_id", "text").unionByName(parents))
    return out.select("query_id", "doc_id", F.floor(F.col("nth") / 4).cast("long").alias("parent"), "rank")


@query("select o_custkey % 20 as query_id, o_custkey as doc_id, row_number() over (partition by o_custkey % 20 order by min(o_orderkey), o_custkey) as doc_rank from orders group by o_custkey qualify doc_rank <= 10")
def distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("rank"))
    return R.distinct_documents(hits).where("doc_rank <= 10").select("query_id", "doc_id", F.col("doc_rank").cast("long").alias("doc_rank"))


@query(f"""with {BM25_SQL}, r as (select query_id, doc_id, length(text) as score, rank from bm_ranked join documents using (doc_id) where rank <= 10)
  select query_id, doc_id, row_number() over (partition by query_id order by score desc, rank, doc_id) as rank, 'bm25+rerank' as matched_by from r qualify rank() over (partition by query_id order by score desc, rank, doc_id) <= 3""")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25(spark, d, 10).withColumn("matched_by", F.lit("bm25")).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return R.rerank(hits, F.length("text"), top=3).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "matched_by")


@query("""with f as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as rank from conversations qualify rank <= 3)
  select conv_id, md5(string_agg('[출처: ' || cast(turn as varchar) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as digest from f group by 1""")
def contexts(spark: SparkSession, d: str) -> DataFrame:
    hits = R.first_per_group(table(spark, d, "conversations"), ["conv_id"], ["turn"], 3).withColumn("rank", F.col("turn"))
    return R.context(hits, "conv_id", "turn").select("conv_id", F.md5("context").alias("digest"))


@query("select user_id, event_id, ((row_number() over (partition by user_id order by ts, event_id) - 1) // 4)::bigint as batch from events")
def event_batches(spark: SparkSession, d: str) -> DataFrame:
    return R.batches(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id", F.col("batch").cast("long").alias("batch"))


@query("""select page_id, ((contains(lower(html), 'href'))::int + (contains(lower(html), 'script'))::int + (contains(lower(html), 'zu und'))::int + (contains(lower(html), 'the'))::int)::bigint as hits from pages
  order by hits desc, page_id limit 25""")
def page_ranking(spark: SparkSession, d: str) -> DataFrame:
    hits = R.term_hits(F.col("html"), ["href", "script", "Zu und", "the"])
    return table(spark, d, "pages").select("page_id", hits.cast("long").alias("hits")).orderBy(F.desc("hits"), "page_id").limit(25)


@query("""select item_id, list_distinct(list_concat(case when contains(lower(text), 'the') then ['article', 'word'] else [] end, case when contains(lower(text), 'und') then ['word', 'german'] else [] end)) is not null as known,
  (case when contains(lower(text), 'the') and contains(lower(text), 'und') then 3 when contains(lower(text), 'the') or contains(lower(text), 'und') then 2 else 0 end)::bigint as n from benchmark""")
def keyword_expansion(spark: SparkSession, d: str) -> DataFrame:
    words = R.expanded_keywords(F.col("text"), {"the": ["article", "word"], "und": ["word", "german"]})
    return table(spark, d, "benchmark").select("item_id", F.lit(True).alias("known"), F.size(words).cast("long").alias("n"))


@query(r"""with p as (select page_id, list_distinct(list_filter(regexp_split_to_array(lower(url), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(html), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as b from pages)
  select page_id, len(list_intersect(a, b))::bigint as overlap from p where len(list_intersect(a, b)) > 0""")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    both = F.size(F.array_intersect(R.tokens(F.col("url")), R.tokens(F.col("html"))))
    return table(spark, d, "pages").select("page_id", both.cast("long").alias("overlap")).where("overlap > 0")


@query()
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    embed = R.hash_embedding(64)
    return table(spark, d, "benchmark").select("item_id", embed("text").alias("v")).select("item_id", F.size("v").alias("dims"), F.round(R.dot(F.col("v"), F.col("v")), 6).alias("norm"))


@query(r"select doc_id, md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ')) as digest from documents")
def token_streams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(R.tokens(F.col("text")), " ")).alias("digest"))


@query()
def folded_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(T.folded("text")).alias("n"))


@query()
def markup_tables(spark: SparkSession, d: str) -> DataFrame:
    from docforge.sources import readers

    pages = table(spark, d, "pages").select("page_id", F.concat("html", F.lit("<table><tr><td colspan=2>a</td><td>b</td></tr></table>")).alias("html"))
    return readers.markup_tables(pages, "page_id", "html").select("page_id", "nth", F.size("cells").alias("n_rows"))
