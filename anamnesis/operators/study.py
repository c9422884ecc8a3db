"""Evaluation statistics: score variants, ranks, conformal quantiles, policies and their outcomes.

Pairs are (question_id, question_type, id, raw, age_hours, evidence, user_bytes, assist_bytes); only what is asked of every pair
goes over them. Ranks and outcomes come from ``ranks``, and what leaves a question there is one row, so everything after it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FOOTER, HEADER, estimate
from ..functions.temporal import time_ago
from .ordering import running_sums

#: The boost of an agent's own memories, the weight of recency as a tie-break, the horizon in hours, the normal quantile of 95 %.
BOOST, TIE, HORIZON, Z = 1.2, 1e-3, 24.0 * 30, 1.959963984540054
OVERHEAD = estimate(HEADER) + estimate(FOOTER)


def decay(age_hours: Column, floor: float = 0.5) -> Column:
    """Linear in age above a floor; unlike the store's recency it isn't cut off at 1."""
    return F.greatest(F.lit(floor), 1.0 - age_hours / HORIZON)


def score_variants(rows: DataFrame) -> DataFrame:
    raw, rec = F.col("raw"), decay(F.col("age_hours"))
    return rows.select("*", F.round(raw * rec * BOOST, 9).alias("production"), F.round(raw + TIE * rec, 9).alias("decay_tiebreak"), F.round(raw * decay(F.col("age_hours"), 0.8) * BOOST, 9).alias("decay_floor_08"))


def line_tokens(most: int = 400) -> Column:
    """The estimate for an injected line."""
    side = lambda c: F.when(F.col(c) <= most, F.col(c)).otherwise(most + 3)
    size = F.length(time_ago(F.col("age_hours") * 3600)) + 3 + 2 + side("user_bytes") + 11 + side("assist_bytes")
    return F.floor(size / 4).cast("long") + 1


def ranked(rows: DataFrame, score: str = "decay_tiebreak", most: int = 400) -> DataFrame:
    """Rows with score, rk, tokens, running tokens and running evidence; questions without evidence are left out."""
    r = score_variants(rows).withColumn("score", F.col(score)).withColumn("tokens", line_tokens(most))
    of = r.groupBy("question_id").agg(F.count_if("evidence").alias("evidence_count"), F.count("*").alias("size")).where("evidence_count > 0")
    sums = {"rk": F.lit(1), "cumulative_tokens": F.col("tokens"), "found": F.col("evidence").cast("int")}
    r = running_sums(r.join(of, "question_id"), ["question_id"], [F.desc("score"), F.col("id")], sums)
    return r.withColumn("rk", F.col("rk").cast("int")).withColumn("recall", F.col("found") / F.col("evidence_count"))


def order_statistic(rows: DataFrame, value: str, index: Column, by: list[str]) -> DataFrame:
    """(by..., n, value): the index-th smallest value per group, null past the end; ``index`` may use the group's size n.

    Values are counted first, so that what is sorted is distinct values.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value)))
    return run.groupBy(*by, "n").agg(F.min(F.when(F.col("upto") >= index, F.col(value))).alias("value"))


def lower_index(alpha: float) -> Column:
    return F.least(F.floor(F.lit(alpha) * (F.col("n") + 1) + 1e-9), F.col("n"))


def rank_index(alpha: float) -> Column:
    return F.greatest(F.lit(1), F.least(F.ceil(F.lit(1 - alpha) * (F.col("n") + 1) - 1e-9), F.col("n")))


def upper_index(alpha: float) -> Column:
    return F.ceil(F.lit(1 - alpha) * (F.col("n") + 1) - 1e-9)


def conformal_threshold(p: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """The lower quantile of the best evidence's scores; minus infinity where there are too few."""
    found = order_statistic(p, "best_score", F.greatest(lower_index(alpha), F.lit(1)), by)
    return found.withColumn("value", F.when(lower_index(alpha) < 1, F.lit(float("-inf"))).otherwise(F.col("value")))


def rank_quantile(p: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    return order_statistic(p, "best_rank", rank_index(alpha), by)


def upper_quantile(p: DataFrame, value: str, alpha: float, by: list[str]) -> DataFrame:
    """Infinity where there are too few."""
    return order_statistic(p, value, upper_index(alpha), by).withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(float("inf"))))


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    p, z2 = successes / total, Z * Z
    center = (p + z2 / (2 * total)) / (1 + z2 / total)
    margin = Z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total)
    return center - margin, center + margin


def aggregate(o: DataFrame, by: list[str]) -> DataFrame:
    """Means over questions, with tokens' quantiles."""
    agg = o.groupBy(*by) if by else o.groupBy()
    return agg.agg(
        F.count("*").alias("n"), F.round(F.avg("coverage"), 9).alias("coverage"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg(F.when(F.col("evidence_count") >= 2, F.col("all_found"))), 9).alias("all_coverage"),
        F.round(F.avg("size"), 9).alias("mean_size"), F.round(F.avg("tokens"), 9).alias("mean_tokens"), F.round(F.percentile("tokens", 0.95), 6).alias("p95_tokens"), F.max("tokens").alias("max_tokens"))


def auroc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """(auroc): by average ranks; equal scores are counted together before anything is sorted."""
    counts = rows.groupBy(score).agg(F.count_if(positive).alias("p"), F.count("*").alias("c"))
    run = running_sums(counts, [], [F.col(score)], {"upto": F.col("c")}).withColumn("before", F.col("upto") - F.col("c"))
    sums = run.agg(F.sum("p").alias("P"), F.sum(F.col("c") - F.col("p")).alias("N"), F.sum(F.col("p") * (F.col("before") + (F.col("c") + 1) / 2)).alias("R"))
    return sums.select(F.round((F.col("R") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * F.col("N")), 9).alias("auroc"))


def age_bucket(hours: Column) -> Column:
    return F.when(hours <= 7 * 24, "<=7d").when(hours <= 30 * 24, "8-30d").otherwise(">30d")


def folds(p: DataFrame, repetitions: int) -> DataFrame:
    """Each question in each repetition, with its half: a hash decides, so no split table is kept."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep")
    return p.select("*", reps).withColumn("calibration", (F.col("question_id") * 31 + F.col("rep") * 17 + F.floor(F.col("question_id") / 50) * (F.col("rep") + 1) + F.floor(F.col("question_id") / 100) * F.col("rep")) % 2 == 0)


def normalised_answer(text: Column) -> Column:
    """Lower case, anything but letters, digits and $ as one space, padded for whole-word search."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}$]+", " ")), F.lit(" "))


def contains_answer(reply: Column, answer: Column) -> Column:
    return normalised_answer(reply).contains(normalised_answer(answer))


def memory_lines(prompt: Column) -> Column:
    """The remembered lines of a rendered prompt."""
    return F.filter(F.split(prompt, "\n"), lambda x: x.startswith("- ["))


def compare_prompts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Whether two prompts are the same, have the same lines in order, and the same set of lines."""
    x, y = memory_lines(a), memory_lines(b)
    return a == b, x == y, F.sort_array(F.array_distinct(x)) == F.sort_array(F.array_distinct(y))


def paired_bootstrap(rows: DataFrame, by: list[str] | None = None, resamples: int = 2000) -> DataFrame:
    """(by..., diff, low, high): the mean difference of (question_id, delta), and the 2.5 % and 97.5 % points under resampling.

    Each question is drawn a Poisson number of times per resample, by a hash, so resamples are sums that combine map-side. Resamples without
    any question don't count.
    """
    by = by or []
    drawn = rows.select(*by, "question_id", "delta", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep"))
    u = F.pmod(F.xxhash64("question_id", "rep"), F.lit(1 << 40)) / float(1 << 40)
    times, edge, total = F.lit(0), 1.0, 0.36787944117144233
    for k in range(1, 8):  # the Poisson distribution of mean 1
        times = times + (u > total).cast("int")
        edge /= k
        total += 0.36787944117144233 * edge
    means = drawn.withColumn("t", times).groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("delta") * F.col("t")), F.sum("t")).alias("mean"), F.sum("delta").alias("s"), F.count("*").alias("n"))
    return means.groupBy(*by).agg((F.max("s") / F.max("n")).alias("diff"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def by_type(rows: DataFrame) -> DataFrame:
    """Rows twice: under their question's type, and under 'overall', in a column ``kind``."""
    return rows.withColumn("kind", F.explode(F.array(F.lit("overall"), F.col("question_type"))))


def summarize(outcomes: DataFrame, baseline: DataFrame) -> DataFrame:
    """(kind, questions, means..., diff): overall and per type, with the mean difference of coverage from a baseline's same questions."""
    b = baseline.select("question_id", F.col("coverage").alias("before"))
    return by_type(outcomes.join(b, "question_id")).groupBy("kind").agg(
        F.count("*").alias("questions"), F.round(F.avg("coverage"), 9).alias("coverage"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("tokens"), 9).alias("mean_tokens"),
        F.round(F.avg("size"), 9).alias("mean_lines"), F.round(F.avg(F.col("coverage") - F.col("before")), 9).alias("diff"))


def age_metrics(p: DataFrame, alpha: float, repetitions: int) -> DataFrame:
    """(bucket, method, coverage, n): by the age of the youngest evidence, over the repetitions in which the bucket was tested.

    A threshold on the score, fitted on one half of the questions, against the five best, both measured on the other half.
    """
    f = folds(p.withColumn("bucket", age_bucket(F.col("youngest"))), repetitions)
    cut = conformal_threshold(f.where("calibration"), alpha, ["rep"]).select("rep", F.col("value").alias("cut"))
    tested = f.where("NOT calibration").join(F.broadcast(cut), "rep")  # a row per repetition
    means = tested.groupBy("rep", "bucket").agg(F.avg((F.col("best_score") >= F.col("cut")).cast("int")).alias("threshold"), F.avg((F.col("best_rank") <= 5).cast("int")).alias("top_5"))
    each = means.select("bucket", F.explode(F.create_map(F.lit("threshold"), "threshold", F.lit("top_5"), "top_5")).alias("method", "coverage"))
    return each.groupBy("bucket", "method").agg(F.round(F.avg("coverage"), 9).alias("coverage"), F.count("*").alias("n"))


def deterministic_subset(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows whose seeded hashes come first."""
    return rows.withColumn("digest", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).orderBy("digest").limit(n)
