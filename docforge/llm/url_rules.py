"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a name, an action (allow or block), a pattern, and literal tokens that every URL it fits must have as whole
tokens (runs of a-z, 0-9 of the lower-cased URL). Each rule stands in the index under the one of its tokens that fewest
URLs have. The tokens of a URL fetch candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of patterns and names that are broadcast as one index; more rules are joined by token instead.
BROADCAST_CHARS = 4_000_000
_TOKEN = re.compile("[a-z0-9]+")
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RULE = T.StructType([T.StructField(n, t) for n, t in (("name", T.StringType()), ("action", T.StringType()), ("weight", T.IntegerType()), ("pattern", T.StringType()), ("tokens", T.ArrayType(T.StringType())))])


@dataclass(frozen=True)
class Rule:
    """``weight`` orders the rules that fit: the largest wins, then block before allow, then the smaller name."""

    name: str
    action: str
    weight: int
    pattern: str
    tokens: tuple[str, ...]


def site(host: str, path: str, action: str) -> Rule:
    """A rule for a host with all its subdomains, and paths that start with ``path``; longer ones win.

    It is matched on the lower-cased host followed by the path, so ``net`` and ``/`` give the name ``net/``. The
    path's last token may go on in the URL (``/en`` fits ``/english``), so it is a literal only if a separator follows.
    """
    whole = re.sub(r"[A-Za-z0-9]+$", "", path)
    return Rule(host + path, action, 1_000_000 + len(host + path), rf"^(?:[^/?#]*\.)?{re.escape(host)}(?=[/?#]|\Z){re.escape(path)}", tuple(dict.fromkeys(_TOKEN.findall(host) + _TOKEN.findall(whole.lower()))))


def pattern(name: str, action: str, regex: str, *tokens: str) -> Rule:
    """A rule on the lower-cased host and all that follows it; site rules win over it."""
    return Rule(name, action, len(name), regex, tokens)


#: Of the registered query. The site rules that are asked for.
SITES = (site("net", "/", "block"), site("example.net", "/en/", "allow"), site("example.com", "/de/", "block"), site("org", "/fr/", "allow"))
#: The method's own judgement where no site rule fits: pages that hold no prose of their own. All others are allowed.
PAGES = (
    *(pattern(f"*/{w}", "block", rf"/{w}(?:[/.?#]|\Z)", w) for w in ("login", "signin", "signup", "register", "cart", "checkout", "search", "feed", "rss")),
    pattern("*/wp-admin", "block", r"/wp-admin(?:[/.?#]|\Z)", "wp", "admin"),
    pattern("?utm_source=feed", "block", r"[?&]utm_source=feed(?:[&#]|\Z)", "utm", "source", "feed"),
    pattern("?replytocom=", "block", r"[?&]replytocom=", "replytocom"),
    *(pattern(f"?{w}=", "block", rf"[?&]{w}=", w) for w in ("sessionid", "phpsessid", "jsessionid")),
    *(pattern(f"*.{w}", "block", rf"\.{w}(?:[?#]|\Z)", w) for w in ("jpg", "jpeg", "png", "gif", "css", "js", "zip", "exe", "mp3", "mp4")),
)


def host_of(url: str | Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), *_LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _matched(url: str | None) -> str:
    """The text that patterns run on: lower-cased host and what follows it as it stands."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]) + rest[cut:]


def _tokens(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def _better(a: tuple, b: tuple | None) -> bool:
    order = lambda x: (-x[2], x[1] != "block", x[0])
    return b is None or order(a) < order(b)


def rule_frame(spark, rules: Iterable[Rule]) -> DataFrame:
    """Rules as rows: name, action, weight, pattern, tokens."""
    return spark.createDataFrame([(r.name, r.action, r.weight, r.pattern, list(r.tokens)) for r in rules], _RULE)


def _counting(literals) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = literals.value, {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for token in _tokens(_matched(url)) & wanted:
                    counts[token] = counts.get(token, 0) + 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def _judging(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token, compiled = index.value, {}
        for batch in batches:
            names, actions, tried = [], [], []
            for url in batch.column(0).to_pylist():
                text, best, n = _matched(url), None, 0
                for token in (*(_tokens(text)), ""):
                    for rule in by_token.get(token, ()):
                        n += 1
                        if rule[3] not in compiled:
                            compiled[rule[3]] = re.compile(rule[3])
                        if _better(rule, best) and compiled[rule[3]].search(text):
                            best = rule
                names.append(best and best[0])
                actions.append(best and best[1])
                tried.append(n)
            found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(actions, pa.string()), pa.array(tried, pa.int32())], ["rule", "action", "tried"])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], [*batch.schema.names[1:], "_found"])

    return run


def _by_broadcast(rows: DataFrame, url: str, rules: list[tuple]) -> DataFrame:
    spark = rows.sparkSession
    literals = {t for r in rules for t in r[4]}
    counted = rows.select(url).mapInArrow(_counting(spark.sparkContext.broadcast(literals)), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    rare = {r.token: r.n for r in counted}
    index: dict[str, list[tuple]] = {}
    for rule in rules:
        index.setdefault(min(rule[4], key=lambda t: (rare.get(t, 0), t), default=""), []).append(rule)
    schema = T.StructType([*rows.schema.fields, T.StructField("_found", T.StructType([T.StructField("rule", T.StringType()), T.StructField("action", T.StringType()), T.StructField("tried", T.IntegerType())]))])
    return rows.select(F.col(url).alias("_url"), "*").mapInArrow(_judging(spark.sparkContext.broadcast(index)), schema)


def _trying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [bool(re.search(p, _matched(u))) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(hits))


def _by_join(rows: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """The same by an equi-join of the tokens of distinct URLs with the rules' rarest tokens; AQE splits frequent tokens."""
    urls = rows.where(F.col(url).isNotNull()).select(F.col(url).alias("_url")).distinct()
    rest = _rest("_url")
    tokens = F.array_union(F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit("([a-z0-9]+)"), F.lit(1))), F.array(F.lit("")))
    each = urls.select("_url", F.explode(tokens).alias("token"))
    named = rules.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    often = each.join(named.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("often"))
    keyed = named.join(often, "token", "left").groupBy("name", "action", "weight", "pattern").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))["token"].alias("token"))
    pairs = each.join(keyed, "token").select("_url", "pattern", "name", "action", "weight")
    fits = pairs.mapInArrow(_trying, pairs.schema)
    best = fits.groupBy("_url").agg(F.min(F.struct((-F.col("weight")).alias("w"), (F.col("action") != "block").alias("a"), "name", "action")).alias("b"))
    judged = best.select("_url", F.struct(F.col("b.name").alias("rule"), F.col("b.action").alias("action"), F.lit(None).cast("int").alias("tried")).alias("_found"))
    return rows.join(judged, F.col(url) == F.col("_url"), "left").drop("_url")


def judge(rows: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows with ``_found`` (rule, action, tried: patterns run; all of it or its parts null where none fits), ``_verdict``.

    ``rules`` has name, action, weight, pattern (Python's syntax, on the host in lower case and what follows it) and
    tokens. Of rules that fit, the largest weight wins, then block, then the smaller name; where none fits the verdict
    is ``default``. A null URL, or one without ``://``, has no text: only rules without tokens can fit it. Rules
    without tokens are tried on all URLs. Repeated rows are judged each, columns stay; those named ``_found``, ``_url`` and ``_verdict``
    are taken by the result. The rules' size is measured first: up to ``broadcast_chars`` characters their index is
    broadcast and rows are not shuffled; beyond it tokens are joined.
    """
    clear = rows.drop("_found", "_url", "_verdict")
    size = rules.agg(F.sum(F.length("pattern") + F.length("name") + F.length(F.concat_ws(" ", "tokens")))).first()[0] or 0
    if size <= broadcast_chars:
        found = _by_broadcast(clear, url, [(r.name, r.action, r.weight, r.pattern, list(r.tokens or [])) for r in rules.select("name", "action", "weight", "pattern", "tokens").collect()])
    else:
        found = _by_join(clear, url, rules)
    return found.withColumn("_verdict", F.coalesce("_found.action", F.lit(default)))


def report(pages: DataFrame, sites: Iterable[Rule] = SITES, others: Iterable[Rule] = PAGES) -> DataFrame:
    """page_id, host, path, rule (the site rule that decides, else null), verdict (allow or block)."""
    rules = rule_frame(pages.sparkSession, [*sites, *others])
    named = [r.name for r in sites]
    judged = judge(pages.select("page_id", "url"), rules)
    return judged.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), F.when(F.col("_found.rule").isin(named), F.col("_found.rule")).alias("rule"), F.col("_verdict").alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL is allowed, with all their columns."""
    return judge(pages, rules, url).where("_verdict = 'allow'").select(*pages.columns)
