"""Context blocks under a token budget: greedy prefixes of ranked lines as running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NOW
from ..functions.text import FACTS_HEADER, FOOTER, HEADER, MEMORIES_HEADER, compress_side, count_tokens, estimate, fact_line, memory_line, sticky_line
from ..functions.temporal import time_ago

FRAME = estimate(HEADER) + estimate(FOOTER)


def found_lines(found: DataFrame, memories: DataFrame, most: int = 400, absolute: bool = False, sticky: bool = False, now: float = NOW) -> DataFrame:
    """(query_id, rk, id, line): results of a search with their text, which is joined only after the top k are known."""
    line = sticky_line if sticky else lambda u, a, c, m: memory_line(u, a, c, now, m, absolute)
    text = memories.select("id", "user_text", "assist_text", "created_at")
    return found.select("query_id", "rk", "id").join(text, "id").select("query_id", "rk", "id", line(F.col("user_text"), F.col("assist_text"), F.col("created_at"), most).alias("line"))


def compressed_lines(found: DataFrame, memories: DataFrame, sentences: DataFrame, queries: DataFrame, most: int = 200, now: float = NOW) -> DataFrame:
    """(query_id, rk, id, line): lines whose sides keep the sentences nearest to the query.

    ``sentences`` has memory_id, side, idx, start_byte, end_byte, embedding.
    """
    spans = sentences.groupBy(F.col("memory_id").alias("id")).agg(*(
        F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("idx", "start_byte", "end_byte", "embedding")))).alias(name) for side, name in (("u", "us"), ("a", "as"))))
    squeeze = compress_side(most)
    rows = found.select("query_id", "rk", "id").join(memories.select("id", "user_text", "assist_text", "created_at"), "id").join(spans, "id", "left").join(queries.select("query_id", "query_emb"), "query_id")
    stamp = time_ago(F.lit(now) - F.col("created_at"))
    line = F.concat(F.lit("- ["), stamp, F.lit("] "), squeeze("user_text", "us", "query_emb"), F.lit(" Response: "), squeeze("assist_text", "as", "query_emb"))
    return rows.select("query_id", "rk", "id", line.alias("line"))


def within(lines: DataFrame, budget, first_extra: int = 0, counter=None) -> DataFrame:
    """The lines of each query's longest prefix by rk that fits the budget; the first is charged ``first_extra`` more.

    Every line costs a token at least, so the running sum rises and the prefix ends at the first line that doesn't fit.
    """
    w = Window.partitionBy("query_id").orderBy("rk")
    cost = count_tokens(counter)(F.concat("line", F.lit("\n"))) + F.when(F.row_number().over(w) == 1, first_extra).otherwise(0)
    return lines.withColumn("cost", cost).withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget)


def _body(lines: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rk", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    return lines.groupBy("query_id").agg(F.count("*").cast("int").alias("n_lines"), F.max("used").alias("used_tokens"), F.array_join(ordered, "").alias("body"), F.sort_array(F.collect_list(F.struct("rk", "id"))).alias("ranked"))


def unbudgeted(lines: DataFrame) -> DataFrame:
    """(query_id, context): all lines."""
    return _body(lines.withColumn("used", F.lit(0))).select("query_id", F.concat(F.lit(HEADER), F.col("body"), F.lit(FOOTER)).alias("context"))


def budgeted(lines: DataFrame, most_tokens: int) -> DataFrame:
    """(query_id, n_lines, used_tokens, context, ids): queries for which nothing fits have no row."""
    body = _body(within(lines, most_tokens - FRAME))
    return body.select("query_id", "n_lines", "used_tokens", F.concat(F.lit(HEADER), F.col("body"), F.lit(FOOTER)).alias("context"), F.transform("ranked", lambda x: x["id"]).alias("ids"))


def facts_first(facts: DataFrame, lines: DataFrame, most_tokens: int, now: float = NOW) -> DataFrame:
    """(query_id, n_facts, n_lines, context): facts, then memories with what is left; each section's heading is charged with its first line.

    Queries without facts among the candidates get the block without headings.
    """
    budget = most_tokens - FRAME
    told = facts.select("query_id", "rk", fact_line(F.col("subject"), F.col("attribute"), F.col("value"), F.col("created_at"), now).alias("line"), "id")
    f = _body(within(told, budget, estimate(FACTS_HEADER)))
    f = told.select("query_id").distinct().join(f, "query_id", "left").select("query_id", F.coalesce("n_lines", F.lit(0)).alias("n_facts"), F.coalesce("used_tokens", F.lit(0)).alias("fact_tokens"), F.coalesce("body", F.lit("")).alias("fact_body"))
    rest = lines.join(f.select("query_id", "fact_tokens"), "query_id")
    m = _body(within(rest, F.lit(budget) - F.col("fact_tokens"), estimate(MEMORIES_HEADER))).select("query_id", "n_lines", "body")
    both = f.join(m, "query_id", "left").select("query_id", "n_facts", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.concat(
        F.lit(HEADER), F.when(F.col("n_facts") > 0, F.concat(F.lit(FACTS_HEADER), F.col("fact_body"))).otherwise(F.lit("")),
        F.when(F.col("body").isNotNull(), F.concat(F.lit(MEMORIES_HEADER), F.col("body"))).otherwise(F.lit("")), F.lit(FOOTER)).alias("context"))
    plain = budgeted(lines.join(told.select("query_id").distinct(), "query_id", "left_anti"), most_tokens).select("query_id", F.lit(0).alias("n_facts"), "n_lines", "context")
    return both.where("n_facts + n_lines > 0").unionByName(plain)
