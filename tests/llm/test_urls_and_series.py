"""URL rules against plain matching of every rule, and change points against all cuts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docforge.llm import change_points as C
from docforge.llm import url_rules as U

URLS = [
    "https://a.example.net/en/1", "http://EXAMPLE.net/en/", "https://example.net/EN/1", "http://net/", "http://net", "http://x.net?y=/", "https://x.net#/", "https://notnet/", "http://a.example.com/de/9", "http://example.com/den/9",
    "https://x.org/fr/1?utm_source=feed", "https://x.org/fr", "https://x.org/en/?utm_source=feed", "https://x.org/en/?a=1&utm_source=feed#t", "https://x.org/?utm_source=feeds", "http://h.de/login", "http://h.de/loginx", "http://h.de/a/Login.html", "http://h.de/pic.jpg",
    "http://h.de/pic.jpg?x=1", "http://h.de/pic.jpgs", "ftp://u:p@b.net:21/en/", "://", "://x.net/", "no scheme", "", None, "http://a://b.net/en/x", "http://a?b.net/", "http://Ünet/", "http://ex\u212Ample.net/en/", "http://h.de/wp-admin/x", "http://b.example.net/en/x\n", "http://h.de/login\n", "http://a.net/\u212Ax",
]


def plain(url, rules):
    """Every rule's pattern on every URL, no index."""
    text, host, path = "", "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        tail, host = rest[len(host) :], "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path, text = re.match("[^?#]*", tail)[0], host + tail
    fit = sorted((-r.weight, r.action != "block", r.name) for r in rules if re.search(r.pattern, text))
    return host, path, fit[0][2] if fit else None, ("allow" if not fit or fit[0][1] else "block")


@pytest.mark.parametrize("limit", [U.BROADCAST_CHARS, 0])
def test_rules(spark, limit):
    extra = (U.pattern("any-one", "block", r"^h\.de/a/", "h", "de"), U.pattern("no-token", "block", r"x{3}"), U.site("h.de", "/pic", "allow"))
    rules = [*U.SITES, *U.PAGES, *extra]
    urls = [*URLS, "http://q/xxx", "http://h.de/a/b", "http://h.de/picture"]
    rows = spark.createDataFrame([(i, u, "n", "t") for i, u in enumerate(urls * 2)], "page_id long, url string, token string, _found string")
    got = U.judge(rows, U.rule_frame(spark, rules), broadcast_chars=limit)
    assert got.columns == ["page_id", "url", "token", "_found", "_verdict"]
    found = {r.page_id: (r["_found"]["rule"] if r["_found"] else None, r["_verdict"]) for r in got.collect()}
    assert found == {i: plain(u, rules)[2:] for i, u in enumerate(urls * 2)}
    if limit:
        tried = {r.page_id: r["_found"]["tried"] for r in got.collect()}
        assert max(tried.values()) <= 6 < len(rules), "few patterns run on a URL"
    assert U.judge(rows.limit(0), U.rule_frame(spark, rules), broadcast_chars=limit).count() == 0
    kept = U.allowed(rows, U.rule_frame(spark, rules))
    assert kept.columns == rows.columns and kept.count() == sum(v == "allow" for _, v in found.values())


def test_url_report(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.report(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()}
    names = {r.name for r in U.SITES}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u, [*U.SITES, *U.PAGES])
        assert got[i] == (host, path, rule if rule in names else None, verdict)
    assert got[0][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block") and got[26] == ("", "", None, "allow")


def cheapest(days, least, penalty):
    """The best of all cuts by plain dynamic programming on tuples."""
    n = len(days)

    def segment(a, b):
        m, s, q = b - a, sum(days[a:b]), sum(x * x for x in days[a:b])
        v = 1 + (m * q - s * s) // (m * m)
        return s, v, m * math.floor(1000 * math.log(v))

    best = [(0, 0, ())] + [None] * n
    for t in range(1, n + 1):
        for a in range(t):
            if best[a] and t - a >= min(least, n):
                new = (best[a][0] + segment(a, t)[2] + (penalty if a else 0), best[a][1] + 1, (a, *best[a][2]))
                best[t] = min(new, best[t] or new)
    starts = [*reversed(best[n][2]), n]
    return [(i + 1, a, b - a, *segment(a, b), best[n][1], best[n][0]) for i, (a, b) in enumerate(zip(starts, starts[1:]))]


@pytest.mark.parametrize("least,penalty", [(14, 40_000), (3, 500), (1, 0)])
def test_change_points(spark, least, penalty):
    r = random.Random(least)
    series = [[r.randrange(5) * 10 ** r.choice([0, 1, 3]) * (1 + 30 * ((i // 20) % 2)) for i in range(n)] for n in (1, 2, 3, 13, 14, 15, 27, 28, 29, 41, 42, 56, 75) for _ in range(4)]
    series += [[7] * 60, [0] * 30 + [5] * 30, [x * 10**7 for x in range(40)], [3 * 10**9, 0, 7] * 12]
    rows = spark.createDataFrame([(i, 50 + i, d) for i, d in enumerate(series)] + [(None, 1, [1, 2]), (999, 0, [])], "key long, first_day long, days array<long>")
    got = {}
    for x in C.change_points(rows, least, penalty).collect():
        got.setdefault(x.key, []).append(tuple(x)[1:])
    for i, d in enumerate(series):
        assert sorted(got[i]) == [(no, 50 + i + a, *rest) for no, a, *rest in cheapest(d, least, penalty)]
    assert len(got) == len(series) + 1 and None in got and 999 not in got
    with pytest.raises(Exception, match="OVERFLOW|OUT_OF_RANGE"):
        C.change_points(spark.createDataFrame([(1, 0, [x * 10**9 for x in range(40)])], rows.schema), 40, 0).collect()


def test_daily_totals_and_odd_rows(spark):
    rows = [(1, 5, "2024-01-01 23:59:59"), (1, 5, "2024-01-01 23:59:59"), (1, None, "2023-01-01 00:00:00"), (1, 2, None), (1, 1, "2024-01-04 00:00:00"), (None, 3, "2024-02-01 00:00:00"), (2, None, None), (3, 0, "1969-12-31 10:00:00")]
    schema = "vendor_id long, quantity int, shipped_at string, key string, day string, days string, total string"
    lines = spark.createDataFrame([(*x, "k", "d", "x", None) for x in rows], schema).withColumn("shipped_at", F.to_timestamp_ntz("shipped_at"))
    got = {r.key: (r.first_day, r.days) for r in C.daily_totals(lines, "vendor_id", "shipped_at", "quantity").collect()}
    assert got == {1: (19723, [10, 0, 0, 1]), None: (19754, [3]), 3: (-1, [0])}
    out = {(r.vendor_id, r.first_day, r.n_days, r.total, r.spread, r.cost, r.n_segments, r.best_cost) for r in C.report(lines).collect()}
    assert out == {(1, 19723, 4, 11, 18, 4 * 2890, 1, 4 * 2890), (None, 19754, 1, 3, 1, 0, 1, 0), (3, -1, 1, 0, 1, 0, 1, 0)}
    assert C.report(lines.limit(0)).count() == 0
