"""Queries on words: the learned cuts of all words of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.operators import names, segments
from docforge.operators.retrieval import tokens
from docforge.plans.common import table
from docforge.plans.registry import query


def _prices(n: int, counts: str) -> str:
    """Prices of counted pieces: single characters, and others that are frequent."""
    return f"""k{n} as (select piece, sum(n) as n from {counts} group by 1 having length(piece) = 1 or sum(n) >= {segments.LEAST} order by sum(n) desc, piece limit {segments.PIECES}),
  t{n} as (select sum(n) as total from k{n}), p{n} as (select piece, floor(1000 * ln(total / n::double))::bigint as price from k{n}, t{n})"""


def _cuts(n: int) -> str:
    """The cheapest cuts of all runs with the prices p{n}: the lattice from the end, then the walk from the front."""
    return f"""o{n} as (select run, a, list({{'c': coalesce(price, unknown), 's': s}}) as options from (select run, s.a, s.s, price, (select floor(1000 * ln(total / 0.5))::bigint from t{n}) as unknown from spans s left join p{n} on p{n}.piece = s.piece) where price is not null or s = 1 group by 1, 2),
  l{n} as (select run, list(options order by a) as o from o{n} group by 1),
  r{n} as (select run, o, len(o) as a, [{{'c': 0::bigint, 'k': 0::bigint, 's': 0::bigint}}] as best from l{n} union all select run, o, a - 1, list_prepend(list_min(list_transform(o[a], lambda x: {{'c': x.c + best[x.s].c, 'k': best[x.s].k + 1, 's': -x.s}})), best) from r{n} where a > 0),
  w{n} as (select run, best, 0::bigint as a, -best[1].s as size from r{n} where a = 0 union all select run, best, a + size, -best[a + size + 1].s from w{n} where a + size < len(best) - 1),
  c{n} as (select run, a, substr(run, a + 1, size) as piece, best[1].c as price from w{n})"""


@query(rf"""with recursive words as (select word, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as word from documents) group by 1),
  runs as (select word, n, nth, substr(word, nth * {segments.RUN} + 1, {segments.RUN}) as run from (select word, n, unnest(range(0, (length(word) + {segments.RUN - 1}) // {segments.RUN})) as nth from words)),
  seeds as (select substr(word, a, s) as piece, 1 as n from (select word, a, unnest(range(1, least({segments.LONGEST}, length(word) - a + 1) + 1)) as s from (select word, unnest(range(1, length(word) + 1)) as a from words))),
  spans as (select run, a, s, substr(run, a, s) as piece from (select run, a, unnest(range(1, least({segments.LONGEST}, length(run) - a + 1) + 1)) as s from (select run, unnest(range(1, length(run) + 1)) as a from (select distinct run from runs)))),
  {_prices(0, 'seeds')}, {_cuts(0)}, f as (select piece, 1 as n from c0 join runs using (run)), {_prices(1, 'f')}, {_cuts(1)}
  select word, max(n) as n, sum(price) filter (a = 0)::bigint as price, string_agg(piece, '|' order by nth, a) as pieces from runs join c1 using (run) group by 1""")
def segmented_words(spark: SparkSession, d: str) -> DataFrame:
    """All distinct words with their cuts under a model of one turn."""
    counts = segments.word_counts(table(spark, d, "documents"), tokens(F.col("text")))
    model = segments.fit(counts, turns=1)
    return segments.cut_words(counts, model).select("word", "n", "price", F.array_join("pieces", "|").alias("pieces"))


@query("""with n as (select doc_id, lower(substr(text, 30, 4 + doc_id % 20)) as name from documents)
  select item_id, doc_id from benchmark join n on contains(lower(text), name) where name <> ''""")
def contained_names(spark: SparkSession, d: str) -> DataFrame:
    """Which names of 4 to 23 characters, one of each document, stand in which questions."""
    own = table(spark, d, "documents").select("doc_id", F.lower(F.substring(F.col("text"), F.lit(30), (F.col("doc_id") % 20 + 4).cast("int"))).alias("name"))
    return names.contained(table(spark, d, "benchmark").select("item_id", F.lower("text").alias("text")), own, "item_id", "text", "doc_id", "name")


@query("""select a.client_id, b.client_id as shorter from clients a join clients b on starts_with(a.email, split_part(b.email, '@', 1)) where split_part(b.email, '@', 1) <> '' and a.client_id <> b.client_id group by all""")
def beginning_names(spark: SparkSession, d: str) -> DataFrame:
    """Clients whose address begins with the name of another's."""
    c = table(spark, d, "clients")
    short = c.select(F.col("client_id").alias("shorter"), F.split("email", "@")[0].alias("start"))
    return names.beginning(c, short, "client_id", "email", "shorter", "start").where("client_id <> shorter")
