"""URL filters against plain models, and the plan's freedom from Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import pytest

from anamnesis.llm import hotjoin, urls
from anamnesis.llm.queries import ORACLES, QUERIES, URL_RULES

DIR = "/root/testdata/sf0.001"


def cut(url):
    if url is None or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    raw = re.match("[^/?#]*", rest)[0]
    host = raw.translate({i: i + 32 for i in range(65, 91)})
    tail = rest[len(raw) :]
    return host, re.match("[^?#]*", tail)[0], host + tail


def judged(rows, rules, order):
    """Rows of the operator, by plain dictionaries."""
    held = []
    for key, url in rows:
        host, path, text = cut(url)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
        held.append((key, host, path, text, best and best[0] + best[1], best and best[2], hashlib.md5(text.encode()).hexdigest()[0] < "3"))
    grams = {"allow": defaultdict(int), "block": defaultdict(int)}
    windows = lambda text: [(urls.START * order + text + urls.END)[i : i + order + 1] for i in range(len(text) + 1)]
    for *_, text, _, ruling, out in held:
        if ruling and not out:
            for w in windows(text):
                for k in range(order + 1):
                    grams[ruling][w[order - k :]] += 1
    stats = {kind: defaultdict(lambda: [0, 0]) for kind in grams}
    for kind, own in grams.items():
        for g, n in own.items():
            stats[kind][g[:-1]][0] += n
            stats[kind][g[:-1]][1] += 1

    def probability(kind, w):
        p = urls.UNSEEN
        for k in range(order + 1):
            g = w[order - k :]
            n, t = stats[kind].get(g[:-1], (0, 0))
            if n:
                p = (grams[kind].get(g, 0) + t * p) / (n + t)
        return p

    def score(text):
        micro = [round((math.log(probability("allow", w)) - math.log(probability("block", w))) * 1e6) for w in windows(text)]
        return max(-urls.MOST, min(urls.MOST, math.floor(sum(micro) / len(micro) / 1000)))

    scores = [score(h[3]) for h in held]
    told = [(s, h[5]) for s, h in zip(scores, held) if h[6] and h[5]]
    A, R = (sum(r == kind for _, r in told) for kind in ("allow", "block"))
    trained = all(any(h[5] == kind and not h[6] for h in held) for kind in grams)
    least = min(((sum(s < t for s, r in told if r == "allow") * R + sum(s >= t for s, r in told if r == "block") * A), t) for t in {s for s, _ in told})[1] if trained and A and R else None
    return sorted(((key, host, path, rule, ruling or ("block" if least is not None and s < least else "allow"), s) for s, (key, host, path, _, rule, ruling, _) in zip(scores, held)), key=str)


def run(spark, rows, rules, **options):
    d = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS score", "'r' AS rule", "2 AS row", "'w' AS window", "'html' AS html").repartition(3)
    return sorted(map(tuple, urls.judge(d, rules, **options).collect()), key=str)


@pytest.mark.parametrize(("order", "bound"), [(4, 200_000), (2, 5), (0, 1)])
def test_against_plain_models(spark, order, bound):
    """Nulls, no scheme, odd hosts and characters, repeated rows, long texts, with common windows broadcast and without."""
    r = random.Random(order)
    host = lambda: ".".join([r.choice(["www", "shop", "cheap-pills", "b", "news"]), r.choice(["alpha", "beta", "x1"]), r.choice(["net", "com", "org", "NET", "Org"])])
    rows = [(i, f"http{r.choice(['', 's'])}://{host()}/{r.choice(['en', 'de', 'fr', 'win/cash', 'a b'])}/{r.randrange(999)}{r.choice(['', '?q=://x', '#top', '/é日🙂'])}") for i in range(240)]
    odd = [None, "", "no scheme", "http://", "http:///net/", "http://net", "http://net/", "HTTP://User@A.NET:80/x", "x://net?/", "x://net#a", "://net/", "http://a.net/" + "z" * 20_000, "http://a.net/\x02\x03", "http://subnet/", "a://b://net/"]
    rows += [(1000 + i, u) for i, u in enumerate(odd)] + [rows[0]] * 3 + [(None, rows[1][1])]
    rules = [("net", "/", "block"), ("alpha.net", "/en/", "allow"), ("beta.com", "/de/", "block"), ("org", "/fr/", "allow"), ("x1.org", "", "allow")]
    got = run(spark, rows, rules, order=order, bound=bound)
    assert got == judged(rows, rules, order) and {v for *_, rule, v, _ in got if rule is None} == {"allow", "block"}


def test_without_examples(spark):
    rows = [(1, "http://a.net/x"), (2, "http://b.com/y"), (3, None)]
    assert [r[4] for r in run(spark, rows, [("net", "/", "block")])] == ["block", "allow", "allow"]
    assert [r[4] for r in run(spark, rows, [])] == ["allow"] * 3
    assert run(spark, [], URL_RULES) == []


def test_equal_rules(spark):
    """Of rules of one length the longer host wins, then the first given."""
    rows = [(1, "http://b.a.net/cd/")]
    assert run(spark, rows, [("a.net", "/cd/", "block"), ("b.a.net", "/c", "allow")])[0][3:5] == ("b.a.net/c", "allow")
    assert run(spark, rows, [("a.net", "/c", "block"), ("a.net", "/c", "allow")])[0][4] == "block"


def test_query(spark):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
        want = con.execute(f"SELECT page_id, host, path, rule, verdict, score FROM ({ORACLES['op13_urls']})").fetchall()
    got = QUERIES["op13_urls"](spark, DIR)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


def test_hot_keys_apart(spark):
    r = random.Random(3)
    keys = [int(r.paretovariate(0.6)) % 300 for _ in range(3000)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k long")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", rows["k"] * 2)
    for bound in (1, 7, 10_000):
        got = hotjoin.hot_apart(rows, table, "k", "n", bound)
        assert sorted(map(tuple, got.select("i", "v").collect())) == [(i, 2 * k) for i, k in enumerate(keys)] and got.columns == ["k", "i", "v"]
    assert hotjoin.hot_apart(rows.limit(0), table.limit(0), "k", "n").count() == 0
