"""Queries on the evaluation study."""

from pyspark.sql import functions as F

from ..config import NOW
from ..operators import context, ranks, retrieval, study
from ..sources.scratch import kept
from ..sources.store import EXCHANGES_SQL, MEMORIES_SQL, exchanges, memories, preloaded, queries, table
from ..sources.study import STUDY_SQL, haystack, questions, similarities
from .context import FOUND_SQL
from .registry import Registry

R = Registry()
SCORE = "round(raw + 1e-3 * greatest(0.5, 1 - age_hours / 720.0), 9)"
AGO = "CASE WHEN age_hours * 3600 < 60 THEN 8 WHEN age_hours < 1 THEN length(concat(floor(age_hours * 60)::BIGINT, 'm ago')) WHEN age_hours < 24 THEN length(concat(floor(age_hours)::BIGINT, 'h ago')) ELSE length(concat(floor(age_hours / 24)::BIGINT, 'd ago')) END"
TOKENS = f"({AGO} + 5 + CASE WHEN user_bytes <= 400 THEN user_bytes ELSE 403 END + 11 + CASE WHEN assist_bytes <= 400 THEN assist_bytes ELSE 403 END) // 4 + 1"
RANKED = f"""WITH {STUDY_SQL}, s AS (SELECT *, {SCORE} AS score, {TOKENS} AS tokens FROM study),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER w AS rk, sum(tokens) OVER w AS cum, sum(evidence::INT) OVER w AS found, sum(evidence::INT) OVER (PARTITION BY question_id) AS ec, count(*) OVER (PARTITION BY question_id) AS size
  FROM s WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, id)) WHERE ec > 0)"""
PROFILES = f"""{RANKED}, p AS (SELECT question_id, question_type, min(rk) FILTER (evidence) AS best_rank, max(rk) FILTER (evidence) AS last_rank, CAST(min(cum) FILTER (evidence) AS BIGINT) AS tokens_to_first, max(score) AS top_score, max(score) FILTER (evidence) AS best_score,
  max(raw) FILTER (rk = 1) AS top1, max(ec) AS ec, min(age_hours) FILTER (evidence) AS youngest, round(max(score) - max(score) FILTER (evidence), 9) AS gap FROM ranked GROUP BY ALL)"""
ALPHAS = (0.05, 0.1, 0.2)


def _known(spark, d, variant="decay_tiebreak"):
    """Questions, memories, and what is known of each question, found by counting."""
    q, m = questions(spark, d), haystack(spark, d)
    return q, m, ranks.extremes(q, m, variant)


def _profiles(spark, d, variant="decay_tiebreak"):
    return ranks.profiles(_known(spark, d, variant)[2])


def _at(spark, d, *ks):
    """Outcomes of the first k memories, for fixed numbers k."""
    q, m, known = _known(spark, d)
    wanted = known.select("question_id", F.explode(F.array(*map(F.lit, ks))).alias("wanted"))
    return ranks.outcomes(known, ranks.first_tokens(ranks.top(q, m, max(ks)), known, wanted))


@R.query("pair_turns", f"WITH {EXCHANGES_SQL} SELECT conv_id, turn, user_text, assist_text FROM exchanges")
def pair_turns(spark, d):
    return exchanges(table(spark, d, "conversations"))


@R.query("subset_sha256", "SELECT vec_id, sha256('seed' || vec_id) AS digest FROM embeddings ORDER BY 2 LIMIT 25")
def subset_sha256(spark, d):
    return study.deterministic_subset(table(spark, d, "embeddings").select("vec_id"), "vec_id", "seed", 25)


@R.query("score_variants", f"""WITH {STUDY_SQL} SELECT question_id, id, raw, round(round(raw * greatest(0.5, 1 - age_hours / 720.0) * 1.2, 9), 6) AS production, round({SCORE}, 6) AS decay_tiebreak, round(round(raw * greatest(0.8, 1 - age_hours / 720.0) * 1.2, 9), 6) AS decay_floor_08 FROM study""")
def score_variants(spark, d):
    """All pairs are wanted: they are scored where they meet, and none is shuffled."""
    v = study.score_variants(similarities(spark, d))
    # as in the SQL, the product decides what is halfway, and not the decimals of the number itself
    return v.select("question_id", "id", "raw", *((F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("production", "decay_tiebreak", "decay_floor_08")))


@R.query("best_evidence_rank", f"{PROFILES} SELECT question_id, CAST(best_rank AS INTEGER) AS best_rank, CAST(last_rank AS INTEGER) AS last_rank FROM p")
def best_evidence_rank(spark, d):
    return _profiles(spark, d).select("question_id", "best_rank", "last_rank")


def _stat_sql(value: str, index: str, alpha: float, by: str = "''", where: str = "true") -> str:
    return f"SELECT g, n, (SELECT min(v) FROM (SELECT {value} AS v, {by} AS g2, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS rn FROM p WHERE {where}) z WHERE g2 = g AND rn >= {index.format(a=alpha)}) AS value FROM (SELECT {by} AS g, count(*) AS n FROM p WHERE {where} GROUP BY 1) c"


LOWER, RANK, UPPER = "greatest(1, least(floor({a} * (n + 1) + 1e-9), n))", "greatest(1, least(ceil((1 - {a}) * (n + 1) - 1e-9), n))", "ceil((1 - {a}) * (n + 1) - 1e-9)"


def _each(build, sql: str, column: str = "alpha"):
    """The union over the three levels."""
    out = None
    for a in ALPHAS:
        part = build(a).withColumn(column, F.lit(a))
        out = part if out is None else out.unionByName(part)
    return out


def _union_sql(head: str, part) -> str:
    return f"{head} " + " UNION ALL ".join(part(a) for a in ALPHAS)


@R.query("conformal_threshold", _union_sql(PROFILES, lambda a: f"SELECT CAST({a} AS DOUBLE) AS alpha, n, CASE WHEN floor({a} * (n + 1) + 1e-9) < 1 THEN '-inf'::DOUBLE ELSE value END AS value FROM ({_stat_sql('best_score', LOWER, a)})"))
def conformal_threshold(spark, d):
    p = _profiles(spark, d).withColumn("g", F.lit(""))
    return _each(lambda a: study.conformal_threshold(p, a, ["g"]), "").select("alpha", "n", "value")


@R.query("rank_quantile", _union_sql(PROFILES, lambda a: f"SELECT CAST({a} AS DOUBLE) AS alpha, n, CAST(value AS INTEGER) AS value FROM ({_stat_sql('best_rank', RANK, a)})"))
def rank_quantile(spark, d):
    p = _profiles(spark, d).withColumn("g", F.lit(""))
    return _each(lambda a: study.rank_quantile(p, a, ["g"]), "").select("alpha", "n", "value")


@R.query("upper_quantile", _union_sql(PROFILES, lambda a: f"SELECT CAST({a} AS DOUBLE) AS alpha, n, coalesce(value, 'inf'::DOUBLE) AS value FROM ({_stat_sql('gap', UPPER, a)})"))
def upper_quantile(spark, d):
    p = _profiles(spark, d).withColumn("g", F.lit(""))
    return _each(lambda a: study.upper_quantile(p, "gap", a, ["g"]), "").select("alpha", "n", "value")


def out_sql(size: str, by: str = "") -> str:
    return f"""o AS (SELECT r.question_id, r.question_type{by}, max((rk <= {size} AND evidence)::INT) AS coverage, max(CASE WHEN rk <= {size} THEN found / ec ELSE 0 END) AS recall, min(CASE WHEN evidence THEN (rk <= {size})::INT END) AS all_found, sum((rk <= {size})::INT) AS size,
  max(ec) AS ec, coalesce(max(CASE WHEN rk <= {size} THEN cum END) + {study.OVERHEAD}, 0) AS tokens FROM ranked r"""


AGG = "count(*) AS n, round(avg(coverage), 9) AS coverage, round(avg(recall), 9) AS recall, round(avg(all_found) FILTER (ec >= 2), 9) AS all_coverage, round(avg(size), 9) AS mean_size, round(avg(tokens), 9) AS mean_tokens, round(quantile_cont(tokens::DOUBLE, 0.95), 6) AS p95_tokens, CAST(max(tokens) AS BIGINT) AS max_tokens"


@R.query("topk_coverage", f"{RANKED}, ks AS (SELECT unnest([1, 5, 10]) AS k), {out_sql('k', ', k')}, ks GROUP BY ALL) SELECT k, {AGG} FROM o GROUP BY k")
def topk_coverage(spark, d):
    return study.aggregate(_at(spark, d, 1, 5, 10).withColumnRenamed("wanted", "k"), ["k"])


@R.query("coverage_by_group", f"{RANKED}, {out_sql('5')} GROUP BY ALL) SELECT coalesce(question_type, 'all') AS kind, count(*) AS n, round(avg(coverage), 9) AS coverage, round(avg(size), 9) AS mean_size FROM o GROUP BY GROUPING SETS ((), (question_type))")
def coverage_by_group(spark, d):
    return _at(spark, d, 5).rollup("question_type").agg(F.count("*").alias("n"), F.round(F.avg("coverage"), 9).alias("coverage"), F.round(F.avg("size"), 9).alias("mean_size")).select(F.coalesce("question_type", F.lit("all")).alias("kind"), "n", "coverage", "mean_size")


@R.query("wilson_interval", f"""{PROFILES}, g AS (SELECT question_type, count(*) FILTER (best_rank <= 5)::DOUBLE AS s, count(*)::DOUBLE AS n FROM p GROUP BY 1)
SELECT question_type, CAST(s AS BIGINT) AS s, CAST(n AS BIGINT) AS n, round((p + z2 / (2 * n) - z * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 9) AS low, round((p + z2 / (2 * n) + z * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 9) AS high
FROM (SELECT *, s / n AS p, 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054 AS z2 FROM g)""")
def wilson_interval(spark, d):
    """The interval of each type's coverage at 5."""
    rates = _profiles(spark, d).groupBy("question_type").agg(F.count_if(F.col("best_rank") <= 5).alias("s"), F.count("*").alias("n"))
    low, high = study.wilson(F.col("s"), F.col("n"))
    return rates.select("question_type", "s", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@R.query("auroc", f"""{RANKED}, a AS (SELECT raw, evidence, avg(rn) OVER (PARTITION BY raw) AS r FROM (SELECT raw, evidence, row_number() OVER (ORDER BY raw) AS rn FROM ranked)), t AS (SELECT sum(r) FILTER (evidence) AS R, count(*) FILTER (evidence) AS P, count(*) FILTER (NOT evidence) AS N FROM a)
SELECT round((R - P * (P + 1) / 2) / (P * N), 9) AS auroc FROM t""")
def auroc(spark, d):
    q, m = questions(spark, d), haystack(spark, d)
    return ranks.auroc(q, m, None, ranks.with_evidence(q, m))


@R.query("age_bucket", f"{PROFILES} SELECT CASE WHEN youngest <= 168 THEN '<=7d' WHEN youngest <= 720 THEN '8-30d' ELSE '>30d' END AS bucket, count(*) AS n, round(avg((best_rank <= 5)::INT), 9) AS coverage FROM p GROUP BY 1")
def age_bucket(spark, d):
    p = _profiles(spark, d).withColumn("bucket", study.age_bucket(F.col("youngest")))
    return p.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg((F.col("best_rank") <= 5).cast("int")), 9).alias("coverage"))


@R.query("mondrian_types", f"{PROFILES} SELECT g AS question_type, n, CAST(value AS INTEGER) AS value FROM ({_stat_sql('best_rank', RANK, 0.1, 'question_type')}) WHERE n >= 2")
def mondrian_types(spark, d):
    """Types with enough questions; the study's 30 are 2 here, as there are few questions."""
    return study.rank_quantile(_profiles(spark, d), 0.1, ["question_type"]).where("n >= 2").select("question_type", "n", "value")


def terciles(p):
    e = p.agg(F.percentile("top1", F.lit(1 / 3)).alias("e1"), F.percentile("top1", F.lit(2 / 3)).alias("e2"))
    return p.crossJoin(F.broadcast(e)).withColumn("bin", (F.col("top1") > F.col("e1")).cast("int") + (F.col("top1") > F.col("e2")).cast("int"))  # one row


TERC = f"{PROFILES.replace('p AS (', 'p0 AS (', 1)}, e AS (SELECT quantile_cont(top1, 1/3.0) AS e1, quantile_cont(top1, 2/3.0) AS e2 FROM p0), p AS (SELECT p0.*, (top1 > e1)::INT + (top1 > e2)::INT AS bin FROM p0, e)"


@R.query("mondrian_terciles", f"{TERC} SELECT CAST(g AS INTEGER) AS bin, n, CAST(value AS INTEGER) AS k FROM ({_stat_sql('best_rank', RANK, 0.1, 'bin')})")
def mondrian_terciles(spark, d):
    return study.rank_quantile(terciles(_profiles(spark, d)), 0.1, ["bin"]).select("bin", "n", F.col("value").alias("k"))


@R.query("profile_curves", f"{RANKED} SELECT question_id, CAST(rk AS INTEGER) AS rk, CAST(cum AS BIGINT) AS cumulative_tokens, round(found / ec, 9) AS recall FROM ranked")
def profile_curves(spark, d):
    q, m = questions(spark, d), haystack(spark, d)
    return ranks.curves(ranks.with_evidence(q, m), m).select("question_id", "rk", "cumulative_tokens", F.round("recall", 9).alias("recall"))


CRC = "l AS (SELECT rk, sum(1 - found / ec) AS loss FROM ranked GROUP BY rk), nn AS (SELECT count(DISTINCT question_id) AS n, max(size) AS w FROM ranked)"


@R.query("crc_k", _union_sql(f"{RANKED}, {CRC}", lambda a: f"SELECT CAST({a} AS DOUBLE) AS alpha, CAST(coalesce(min(rk) FILTER ((loss + 1) / (n + 1) <= {a}), max(w)) AS INTEGER) AS k FROM l, nn"))
def crc_k(spark, d):
    m = haystack(spark, d)
    q = ranks.with_evidence(questions(spark, d), m)
    known = kept(q.select("question_id").crossJoin(F.broadcast(m.agg(F.count("*").alias("size")))), "known")  # one row
    rows = kept(ranks.curves(q, m, only_evidence=True).groupBy("rk", "evidence_count").agg(F.count("*").alias("times")), "ranks")
    return _each(lambda a: ranks.crc_k(rows, known, a), "").select("alpha", "k")


def _policy(spark, d, sizes_of):
    """Outcomes of a policy: ``sizes_of`` gives (question_id, wanted, tokens, found) from questions, memories, what is known and profiles."""
    q, m, known = _known(spark, d)
    return ranks.outcomes(known, sizes_of(q, m, known, ranks.profiles(known).withColumn("g", F.lit(""))))


@R.query("token_budget_policy", f"{PROFILES}, b AS (SELECT coalesce(value, 'inf'::DOUBLE) AS b FROM ({_stat_sql('tokens_to_first', UPPER, 0.1)})), z AS (SELECT question_id, count(*) FILTER (cum <= b) AS k FROM ranked, b GROUP BY 1), {out_sql('k')} JOIN z USING (question_id) GROUP BY ALL) SELECT {AGG} FROM o")
def token_budget_policy(spark, d):
    def sizes(q, m, known, p):
        b = study.upper_quantile(p, "tokens_to_first", 0.1, ["g"]).first().value
        if b == float("inf"):
            return ranks.all_of(known)
        least = m.agg(F.min("tokens")).first()[0]
        first = ranks.top(q, m, int(b // least) + 1)  # no more than that can fit
        fits = first.where(F.col("cumulative_tokens") <= b).groupBy("question_id").agg(F.count("*").alias("wanted"), F.max("cumulative_tokens").alias("tokens"), F.max("found").alias("found"))
        return known.select("question_id").join(fits, "question_id", "left").fillna(0)

    return study.aggregate(_policy(spark, d, sizes), [])


@R.query("gap_policy", f"{PROFILES}, b AS (SELECT coalesce(value, 'inf'::DOUBLE) AS b FROM ({_stat_sql('gap', UPPER, 0.1)})), z AS (SELECT question_id, count(*) FILTER (round(top_score - score, 9) <= b) AS k FROM ranked JOIN p USING (question_id), b GROUP BY 1), {out_sql('k')} JOIN z USING (question_id) GROUP BY ALL) SELECT {AGG} FROM o")
def gap_policy(spark, d):
    def sizes(q, m, known, p):
        return ranks.within_gap(q, m, known, study.upper_quantile(p, "gap", 0.1, ["g"]).first().value)

    return study.aggregate(_policy(spark, d, sizes), [])


FLOOR = f"{TERC}, k0 AS (SELECT value AS k0 FROM ({_stat_sql('best_rank', RANK, 0.1)})), kb AS (SELECT g AS bin, value AS kb FROM ({_stat_sql('best_rank', RANK, 0.1, 'bin')})), z AS (SELECT question_id, greatest(kb, k0) AS k FROM p JOIN kb USING (bin), k0)"


def floor_sizes(q, m, known, p):
    """The larger of the tercile's k and the global one."""
    t = terciles(p)
    k0 = study.rank_quantile(p, 0.1, ["g"]).select(F.col("value").alias("k0"))
    kb = study.rank_quantile(t, 0.1, ["bin"]).select("bin", F.col("value").alias("kb"))
    wanted = kept(t.join(F.broadcast(kb), "bin").crossJoin(F.broadcast(k0)).select("question_id", F.greatest("kb", "k0").alias("wanted")), "wanted")  # three rows; one row
    return ranks.first_tokens(ranks.top(q, m, wanted.agg(F.max("wanted")).first()[0] or 1), known, wanted)


@R.query("floor_policy", f"{FLOOR}, {out_sql('k')} JOIN z USING (question_id) GROUP BY ALL) SELECT {AGG} FROM o")
def floor_policy(spark, d):
    return study.aggregate(_policy(spark, d, floor_sizes), [])


@R.query("policy_outcomes", f"{FLOOR}, {out_sql('k')} JOIN z USING (question_id) GROUP BY ALL) SELECT question_id, question_type, coverage, round(recall, 9) AS recall, all_found, CAST(size AS BIGINT) AS size, CAST(tokens AS BIGINT) AS tokens FROM o")
def policy_outcomes(spark, d):
    return _policy(spark, d, floor_sizes).select("question_id", "question_type", "coverage", F.round("recall", 9).alias("recall"), "all_found", "size", "tokens")


FOLDS = "f AS (SELECT p.*, rep, (question_id * 31 + rep * 17 + (question_id // 50) * (rep + 1) + (question_id // 100) * rep) % 2 = 0 AS calibration FROM p, (SELECT unnest(range(200)) AS rep))"


def _split(spark, d):
    """(rep, k, n, coverage, mean_size): the rank policy fitted on one half and measured on the other."""
    f = study.folds(_profiles(spark, d), 200)
    k = study.rank_quantile(f.where("calibration"), 0.1, ["rep"]).select("rep", F.col("value").alias("k"))
    test = f.where("NOT calibration").join(F.broadcast(k), "rep")  # a row per repetition
    return test.groupBy("rep", "k").agg(F.count("*").alias("n"), F.round(F.avg((F.col("best_rank") <= F.col("k")).cast("int")), 9).alias("coverage"), F.round(F.avg(F.least("k", "size")), 9).alias("mean_size"))


SPLIT = f"""{PROFILES.replace('round(max(score)', 'max(size) AS size, round(max(score)')}, {FOLDS}, c AS (SELECT rep, best_rank, count(*) OVER (PARTITION BY rep) AS n, row_number() OVER (PARTITION BY rep ORDER BY best_rank) AS rn FROM f WHERE calibration),
k AS (SELECT rep, min(best_rank) AS k FROM c WHERE rn >= {RANK.format(a=0.1)} GROUP BY rep), sp AS (SELECT rep, k, count(*) AS n, round(avg((best_rank <= k)::INT), 9) AS coverage, round(avg(least(k, size)), 9) AS mean_size FROM f JOIN k USING (rep) WHERE NOT calibration GROUP BY rep, k)"""


@R.query("split_evaluation", f"{SPLIT} SELECT CAST(rep AS INTEGER) AS rep, CAST(k AS INTEGER) AS k, n, coverage, mean_size FROM sp")
def split_evaluation(spark, d):
    return _split(spark, d)


@R.query("repetition_ranges", f"{SPLIT} SELECT round(avg(coverage), 6) AS mean, round(quantile_cont(coverage, 0.05), 6) AS p05, round(quantile_cont(coverage, 0.5), 6) AS median, round(quantile_cont(coverage, 0.95), 6) AS p95 FROM sp")
def repetition_ranges(spark, d):
    s = _split(spark, d).where(~F.isnan("coverage"))
    return s.agg(F.round(F.avg("coverage"), 6).alias("mean"), *(F.round(F.percentile("coverage", p), 6).alias(n) for p, n in ((0.05, "p05"), (0.5, "median"), (0.95, "p95"))))


@R.query("token_accounting", f"{RANKED} SELECT round(avg(tokens), 9) AS mean_tokens, CAST(max(tokens) AS BIGINT) AS max_tokens FROM ranked")
def token_accounting(spark, d):
    """A line's tokens are the same for every question, so memories are counted once."""
    return haystack(spark, d).agg(F.round(F.avg("tokens"), 9).alias("mean_tokens"), F.max("tokens").alias("max_tokens"))


@R.query("dataset_stats", f"WITH {STUDY_SQL}, q AS (SELECT question_id, question_type, count(*) AS m, count(*) FILTER (evidence) AS e FROM study GROUP BY ALL) SELECT question_type, count(*) AS questions, round(avg(m), 9) AS mean_memories, quantile_cont(m::DOUBLE, 0.5) AS median_memories, round(avg(e), 9) AS mean_evidence, round(avg((e = 0)::INT), 9) AS without_evidence FROM q GROUP BY 1")
def dataset_stats(spark, d):
    """Memories are counted by topic, not by question."""
    topics = haystack(spark, d).groupBy("topic").agg(F.count("*").alias("e"))
    q = questions(spark, d).crossJoin(F.broadcast(topics.agg(F.sum("e").alias("m")))).join(topics, "topic", "left").fillna(0, "e")  # one row
    return q.groupBy("question_type").agg(F.count("*").alias("questions"), F.round(F.avg("m"), 9).alias("mean_memories"), F.percentile("m", 0.5).alias("median_memories"), F.round(F.avg("e"), 9).alias("mean_evidence"), F.round(F.avg((F.col("e") == 0).cast("int")), 9).alias("without_evidence"))


NORM = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}$]+', ' ', 'g')) || ' '"


@R.query("answer_match", f"WITH {MEMORIES_SQL}, a AS (SELECT id, assist_text, substr(assist_text, 1 + CAST(id % 7 AS INTEGER), 12) AS answer FROM memories) SELECT id, contains({NORM.format('assist_text')}, {NORM.format('answer')}) AS correct, length(answer) <= 40 AND contains(lower(assist_text), lower(answer)) AS verbatim FROM a")
def answer_match(spark, d):
    a = memories(spark, d, True).select("id", "assist_text", F.substring("assist_text", (F.lit(1) + F.col("id") % 7).cast("int"), F.lit(12)).alias("answer"))
    verbatim = (F.length("answer") <= 40) & F.lower("assist_text").contains(F.lower("answer"))
    return a.select("id", study.contains_answer(F.col("assist_text"), F.col("answer")).alias("correct"), verbatim.alias("verbatim"))


def _prompts(spark, d):
    m = memories(spark, d)
    return context.unbudgeted(context.found_lines(retrieval.search(queries(spark, d), m), m.drop("user_emb", "assist_emb"), 80))


@R.query("prompt_compare", f"{FOUND_SQL} SELECT query_id, query_id % 3 = 0 OR (query_id % 3 = 1 AND max(rk) = 1) AS same_order, query_id % 3 < 2 AS same_set FROM found GROUP BY query_id")
def prompt_compare(spark, d):
    """Prompts against themselves; a third have their lines in reverse, and a third lack the first line."""
    p = _prompts(spark, d).withColumn("lines", study.memory_lines(F.col("context")))
    changed = F.when(F.col("query_id") % 3 == 1, F.reverse("lines")).otherwise(F.slice("lines", 2, 1000))
    other = F.when(F.col("query_id") % 3 == 0, F.col("context")).otherwise(F.array_join(changed, "\n"))
    _, order, same = study.compare_prompts(F.col("context"), other)
    return p.select("query_id", order.alias("same_order"), same.alias("same_set"))


@R.query("evidence_recall", f"{RANKED} SELECT question_id, round(avg((rk <= 5)::INT) FILTER (evidence), 9) AS recall, CAST(count(*) FILTER (rk <= 5) AS BIGINT) AS injected_lines FROM ranked GROUP BY 1")
def evidence_recall(spark, d):
    return _at(spark, d, 5).select("question_id", F.round("recall", 9).alias("recall"), F.col("size").alias("injected_lines"))


@R.query("pareto", f"{RANKED}, ks AS (SELECT unnest([1, 2, 4, 8, 16]) AS k), {out_sql('k', ', k')}, ks GROUP BY ALL) SELECT concat('top_', k) AS method, round(avg(coverage), 9) AS coverage, round(avg(tokens), 9) AS mean_tokens FROM o GROUP BY k")
def pareto(spark, d):
    o = _at(spark, d, 1, 2, 4, 8, 16).withColumnRenamed("wanted", "k")
    return study.aggregate(o, ["k"]).select(F.concat(F.lit("top_"), F.col("k").cast("string")).alias("method"), "coverage", "mean_tokens")


def _deltas(spark, d):
    """Coverage at 5 of one score against another, by question."""
    q, m = questions(spark, d), haystack(spark, d)
    hit = lambda score, name: ranks.profiles(ranks.extremes(q, m, score)).select("question_id", (F.col("best_rank") <= 5).cast("int").alias(name))
    return hit("decay_tiebreak", "a").join(hit("production", "b"), "question_id").select("question_id", (F.col("a") - F.col("b")).alias("delta"))


@R.query("paired_delta", f"""WITH {STUDY_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {SCORE} DESC, id) AS r1, row_number() OVER (PARTITION BY question_id ORDER BY round(raw * greatest(0.5, 1 - age_hours / 720.0) * 1.2, 9) DESC, id) AS r2 FROM study)
SELECT question_id, CAST((min(r1) <= 5)::INT - (min(r2) <= 5)::INT AS INTEGER) AS delta FROM s WHERE evidence GROUP BY 1""")
def paired_delta(spark, d):
    return _deltas(spark, d)


@R.query("paired_bootstrap")
def paired_bootstrap(spark, d):
    """Overall and per type of question."""
    rows = _deltas(spark, d).withColumn("question_type", F.concat(F.lit("type"), (F.col("question_id") % 3).cast("string")))
    return study.paired_bootstrap(study.by_type(rows), ["kind"])


@R.query("type_summary", f"""{RANKED}, {out_sql('8')} GROUP BY ALL), b AS (SELECT question_id, max((rk <= 3 AND evidence)::INT) AS before FROM ranked GROUP BY 1),
k AS (SELECT *, unnest(['overall', question_type]) AS kind FROM o JOIN b USING (question_id))
SELECT kind, count(*) AS questions, round(avg(coverage), 9) AS coverage, round(avg(recall), 9) AS recall, round(avg(tokens), 9) AS mean_tokens, round(avg(size), 9) AS mean_lines, round(avg(coverage - before), 9) AS diff FROM k GROUP BY 1""")
def type_summary(spark, d):
    """Eight results against three, overall and per type."""
    o = kept(_at(spark, d, 3, 8), "outcomes")
    return study.summarize(o.where("wanted = 8"), o.where("wanted = 3"))


@R.query("preloaded_store", f"WITH {STUDY_SQL} SELECT CAST(question_id AS VARCHAR) AS agent_id, id, round({NOW} - age_hours * 3600, 3) AS created_at, round({NOW} - age_hours * 3600, 3) AS updated_at FROM study")
def preloaded_store(spark, d):
    """Each question's haystack as memories of an agent of its own."""
    q, m = questions(spark, d).select("question_id"), haystack(spark, d).select("id", "age_hours")
    few = q.count() <= retrieval.BROADCAST_QUERIES
    m = preloaded(m.crossJoin(F.broadcast(q) if few else q), NOW)
    return m.select("agent_id", "id", F.round("created_at", 3).alias("created_at"), F.round("updated_at", 3).alias("updated_at"))


PRODUCTION = "round(raw * greatest(0.5, 1 - age_hours / 720.0) * 1.2, 9)"


@R.query("age_metrics", f"""{PROFILES.replace(SCORE, PRODUCTION)}, {FOLDS}, c AS (SELECT rep, best_score, count(*) OVER (PARTITION BY rep) AS n, row_number() OVER (PARTITION BY rep ORDER BY best_score) AS rn FROM f WHERE calibration),
t AS (SELECT rep, CASE WHEN floor(0.1 * (max(n) + 1) + 1e-9) < 1 THEN '-inf'::DOUBLE ELSE min(best_score) FILTER (rn >= floor(0.1 * (n + 1) + 1e-9)) END AS cut FROM c GROUP BY rep),
m AS (SELECT rep, CASE WHEN youngest <= 168 THEN '<=7d' WHEN youngest <= 720 THEN '8-30d' ELSE '>30d' END AS bucket, avg((best_score >= cut)::INT) AS a, avg((best_rank <= 5)::INT) AS b FROM f JOIN t USING (rep) WHERE NOT calibration GROUP BY ALL)
SELECT bucket, 'threshold' AS method, round(avg(a), 9) AS coverage, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT bucket, 'top_5', round(avg(b), 9), count(*) FROM m GROUP BY 1""")
def age_metrics(spark, d):
    """By the age of the evidence, over 200 splits."""
    return study.age_metrics(_profiles(spark, d, "production"), 0.1, 200)


GRID = [(k, b) for k in (4, 8) for b in (200, 400)]


@R.query("visibility_grid", f"""{RANKED}, g AS (SELECT unnest([4, 8]) AS k), b AS (SELECT unnest([200, 400]) AS most) SELECT k, most, round(avg(least(user_bytes, most) + least(assist_bytes, most)), 9) AS mean_bytes, round(avg(((user_bytes > most) OR (assist_bytes > most))::INT), 9) AS truncated, round(avg(evidence::INT), 9) AS evidence FROM ranked, g, b WHERE rk <= k GROUP BY ALL""")
def visibility_grid(spark, d):
    """What a line shows of its memory for each k and limit of bytes."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(b).alias("most")) for k, b in GRID))).alias("g")
    q, m = questions(spark, d), haystack(spark, d)
    known = ranks.with_evidence(q, m)
    first = ranks.top(q, m, max(k for k, _ in GRID)).join(known.select("question_id"), "question_id", "left_semi").join(m.select("id", "user_bytes", "assist_bytes"), "id")
    r = first.select("*", each).select("rk", "evidence", "user_bytes", "assist_bytes", "g.k", "g.most").where("rk <= k")
    shown = F.least("user_bytes", "most") + F.least("assist_bytes", "most")
    cut = (F.col("user_bytes") > F.col("most")) | (F.col("assist_bytes") > F.col("most"))
    return r.groupBy("k", "most").agg(F.round(F.avg(shown), 9).alias("mean_bytes"), F.round(F.avg(cut.cast("int")), 9).alias("truncated"), F.round(F.avg(F.col("evidence").cast("int")), 9).alias("evidence"))


@R.query("prompt_lines", f"{FOUND_SQL} SELECT query_id, count(*) AS lines FROM found GROUP BY 1")
def prompt_lines(spark, d):
    """How many remembered lines a rendered prompt has."""
    return _prompts(spark, d).select("query_id", F.size(study.memory_lines(F.col("context"))).cast("long").alias("lines"))
