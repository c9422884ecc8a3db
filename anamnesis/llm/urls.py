"""Operator 13: URL filters by rules and, where no rule fits, by two character models.

A rule is a host, a path and a verdict. It fits URLs on its host or a subdomain whose path starts
with its own; the longest rule wins (by host and path together; among equals that with the longer
host, then the one given first).

URLs that a rule decides are the examples: allowed ones are accepted, blocked ones rejected. From
each kind a Markov model of characters of variable order is counted: the probability of a character
is interpolated (Witten and Bell) from the longest context that was seen, of up to ``order`` characters,
down to none. A URL's score is the difference of its two log-likelihoods over its number of
characters. One URL in ``CALIBRATE``/16 of the examples isn't counted; on these the threshold is
set, to the score with the smallest sum of both kinds' shares of errors (the lowest such score).

Only DataFrame functions are used. Windows of ``order`` + 1 characters are counted once over all
rows; shorter ones are their ends, so they are sums over distinct windows. A window's score is
computed once, in whole millionths, so sums don't depend on the order of rows.

Defined results: what is scored is the URL after its first ``://``, with A-Z of the host in lower
case, or the whole text if it has none; null counts as empty. An end mark is scored too, so no URL
has length zero. Without examples of both kinds, counted and held out, every URL without a rule is allowed. Repeated
rows are judged one by one and count as often as they come. An empty table stays empty. Columns other than the key
and the URL are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialise
from .hotjoin import BOUND, hot_apart

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks around a text, the share of a character that no context has seen, and the sixteenths of examples that are held out.
START, END, UNSEEN, CALIBRATE = "\x02", "\x03", 1 / 256, 3
#: Scores, in thousandths, lie within this.
MOST = 10_000

Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what the models read."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host, tail = F.translate(raw, UPPER, LOWER), F.substring(rest, F.length(raw) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(F.concat(host, tail), url, F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):  # the longest comes last and so is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def windows(text: Column, order: int) -> Column:
    """Of each character and the end mark: it and the ``order`` characters before it."""
    chars = F.split(F.concat(F.lit(START * order), text, F.lit(END)), "")
    return F.transform(F.sequence(F.lit(1), F.size(chars) - order), lambda i: F.array_join(F.slice(chars, i, F.lit(order + 1)), ""))


def interpolated(seen: list[Column], total: list[Column], kinds: list[Column]) -> Column:
    """The probability of a window's last character; lists go from the shortest context to the longest."""
    p = F.lit(UNSEEN)
    for c, n, t in zip(seen, total, kinds):
        p = F.when(n > 0, (c + t * p) / (n + t)).otherwise(p)
    return p


def window_scores(counts: DataFrame, order: int) -> DataFrame:
    """(window, n, micro): the log of both models' ratio in millionths. ``counts`` is (window, n, accepted, rejected)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    ends = counts.select("window", "n", "accepted", "rejected", k).withColumn("gram", F.expr("right(window, k + 1)"))
    seen = ends.where("accepted + rejected > 0").groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    seen = materialise(seen, "url-grams")
    context = lambda g: F.expr(f"left({g}, length({g}) - 1)")
    before = seen.groupBy(context("gram").alias("context")).agg(
        F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("ta"), F.sum("r").alias("nr"), F.count_if(F.col("r") > 0).alias("tr"))
    whole = ends.select("window", "n", "k", "gram", context("gram").alias("context")).join(seen, "gram", "left")
    short = whole.where("k = 0").join(F.broadcast(before.where("context = ''")), "context")  # one row
    found = whole.where("k > 0").join(before, "context", "left").unionByName(short)
    names = ("a", "r", "na", "ta", "nr", "tr")
    wide = found.groupBy("window", "n").agg(*(F.coalesce(F.max(F.when(F.col("k") == i, F.col(c))), F.lit(0)).alias(f"{c}{i}") for c in names for i in range(order + 1)))
    a, r, na, ta, nr, tr = ([F.col(f"{c}{i}") for i in range(order + 1)] for c in names)
    return wide.select("window", "n", F.round((F.log(interpolated(a, na, ta)) - F.log(interpolated(r, nr, tr))) * 1e6).cast("long").alias("micro"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row (least): the lowest score with the fewest errors on held-out examples, each kind's share counting alike; null without both kinds.

    Scores are at most 2 * ``MOST`` + 1 whole numbers, so what is sorted is bounded.
    """
    bins = scored.where("held_out AND ruling IS NOT NULL").groupBy("score").agg(F.count_if(F.col("ruling") == "allow").alias("a"), F.count_if(F.col("ruling") == "block").alias("r"))
    upto, whole = Window.partitionBy(F.lit(0)).orderBy("score"), Window.partitionBy(F.lit(0))
    big = lambda c: c.cast("decimal(19,0)")
    run = bins.select("score", (F.sum("a").over(upto) - F.col("a")).alias("lost"), (F.sum("r").over(whole) - F.sum("r").over(upto) + F.col("r")).alias("passed"), F.sum("a").over(whole).alias("A"), F.sum("r").over(whole).alias("R"))
    errors = big(F.col("lost")) * big(F.col("R")) + big(F.col("passed")) * big(F.col("A"))
    return run.where("A > 0 AND R > 0").agg(F.min_by("score", F.struct(errors.alias("e"), F.col("score").alias("s"))).alias("least"))


def judge(pages: DataFrame, rules: list[Rule], order: int = 4, key: str = "page_id", url: str = "url", bound: int = BOUND) -> DataFrame:
    """(key, host, path, rule, verdict, score): ``score`` is in thousandths of a nat per character, and ``least`` the threshold."""
    host, path, text = parts(F.col(url))
    p = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), text.alias("text"))
    rule, ruling = ruled(F.col("host"), F.col("path"), rules)
    held = F.substring(F.md5(F.col("text").cast("binary")), 1, 1) < f"{CALIBRATE:x}"
    p = materialise(p.select("*", rule.alias("rule"), ruling.alias("ruling"), held.alias("held_out"), F.monotonically_increasing_id().alias("row")), "urls")
    example = lambda v: F.count_if(F.coalesce((F.col("ruling") == v) & ~F.col("held_out"), F.lit(False)))
    each = p.select("row", "ruling", "held_out", F.explode(windows(F.col("text"), order)).alias("window"))
    counts = each.groupBy("window").agg(F.count("*").alias("n"), example("allow").alias("accepted"), example("block").alias("rejected"))
    scores = materialise(window_scores(materialise(counts, "url-windows"), order), "url-scores")
    sums = hot_apart(each.select("row", "window"), scores, "window", "n", bound).groupBy("row").agg(F.sum("micro").alias("micro"), F.count("*").alias("length"))
    score = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.col("micro") / F.col("length") / 1000))).cast("long")
    scored = materialise(p.drop("text").join(sums, "row").select("key", "host", "path", "rule", "ruling", "held_out", score.alias("score")), "url-judged")
    both = counts_of_both(scored)
    limit = threshold(scored).crossJoin(both).select(F.when(F.col("both"), F.col("least")).alias("least"))  # one row each
    verdict = F.coalesce("ruling", F.when(F.col("score") < F.col("least"), "block").otherwise("allow"))
    return scored.join(F.broadcast(limit), how="cross").select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")


def counts_of_both(scored: DataFrame) -> DataFrame:
    """One row (both): whether both kinds have examples that were counted."""
    some = lambda v: F.count_if((F.col("ruling") == v) & ~F.col("held_out")) > 0
    return scored.agg((some("allow") & some("block")).alias("both"))


def judge_sql(rules: list[Rule], order: int = 4) -> str:
    """The same over ``pages`` in SQL for DuckDB."""
    orders = range(order + 1)

    def probability(c: str) -> str:
        step = lambda p, k: f"(CASE WHEN n{c}{k} > 0 THEN ({c}{k} + t{c}{k} * {p}) / (n{c}{k} + t{c}{k}) ELSE {p} END)"
        return reduce(step, orders, f"{UNSEEN}::DOUBLE")

    def case(result: int) -> str:
        order_of = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
        whens = (f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[result]}'" for h, p, v in order_of)
        return f"CASE {' '.join(whens)} END"

    wide = ", ".join(f"coalesce(max({c}) FILTER (k = {k}), 0)::DOUBLE AS {c}{k}" for c in ("a", "r", "na", "ta", "nr", "tr") for k in orders)
    return f"""WITH u AS (SELECT page_id, url, instr(url, '://') AS at, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
t AS (SELECT *, translate(raw, '{UPPER}', '{LOWER}') AS low, substr(rest, length(raw) + 1) AS tail FROM h),
p0 AS (SELECT page_id, coalesce(low, '') AS host, coalesce(regexp_extract(tail, '^[^?#]*'), '') AS path, coalesce(low || tail, url, '') AS text, row_number() OVER () AS row FROM t),
p AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruling, substr(md5(text), 1, 1) < '{CALIBRATE:x}' AS held_out FROM p0),
e AS (SELECT row, ruling, held_out, unnest(list_transform(range(1, length(text) + 2), lambda i: substr(repeat(chr(2), {order}) || text || chr(3), i, {order + 1}))) AS win FROM p),
c AS (SELECT win, count(*) FILTER (ruling = 'allow' AND NOT held_out) AS accepted, count(*) FILTER (ruling = 'block' AND NOT held_out) AS rejected FROM e GROUP BY win),
ends AS (SELECT win, accepted, rejected, k, substr(win, {order + 1} - k, k + 1) AS gram FROM c, (SELECT unnest(range({order + 1})) AS k)),
seen AS (SELECT gram, sum(accepted) AS a, sum(rejected) AS r FROM ends WHERE accepted + rejected > 0 GROUP BY gram),
before AS (SELECT substr(gram, 1, length(gram) - 1) AS context, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(r) AS nr, count(*) FILTER (r > 0) AS tr FROM seen GROUP BY 1),
wide AS (SELECT win, {wide} FROM (SELECT ends.*, a, r, na, ta, nr, tr FROM ends LEFT JOIN seen ON seen.gram = ends.gram LEFT JOIN before ON before.context = substr(ends.gram, 1, length(ends.gram) - 1)) GROUP BY win),
scores AS (SELECT win, CAST(round((ln({probability('a')}) - ln({probability('r')})) * 1e6) AS BIGINT) AS micro FROM wide),
sums AS (SELECT row, CAST(sum(micro) AS BIGINT) AS micro, count(*) AS length FROM e JOIN scores USING (win) GROUP BY row),
scored AS (SELECT p.*, CAST(greatest(-{MOST}, least({MOST}, floor(micro::DOUBLE / length / 1000))) AS BIGINT) AS score FROM p JOIN sums USING (row)),
bins AS (SELECT score, count(*) FILTER (ruling = 'allow') AS a, count(*) FILTER (ruling = 'block') AS r FROM scored WHERE held_out AND ruling IS NOT NULL GROUP BY score),
run AS (SELECT score, sum(a) OVER (ORDER BY score) - a AS lost, sum(r) OVER () - sum(r) OVER (ORDER BY score) + r AS passed, sum(a) OVER () AS A1, sum(r) OVER () AS R1 FROM bins),
best AS (SELECT score AS least FROM run WHERE A1 > 0 AND R1 > 0 ORDER BY lost * R1 + passed * A1, score LIMIT 1),
kinds AS (SELECT count(*) FILTER (ruling = 'allow' AND NOT held_out) > 0 AND count(*) FILTER (ruling = 'block' AND NOT held_out) > 0 AS enough FROM p)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN score < CASE WHEN (SELECT enough FROM kinds) THEN (SELECT least FROM best) END THEN 'block' ELSE 'allow' END) AS verdict, score FROM scored"""
