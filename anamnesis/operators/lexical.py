"""Lexical retrieval (BM25) and its fusion with dense retrieval, batched over queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import release, scratch
from .index import Index

#: Letters that lose their marks, and what they become.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"


def query_terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1)


def match_expression(text: Column) -> Column:
    """The quoted terms joined by OR; empty if there are none."""
    return F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def document_terms(text: Column) -> Column:
    """Words in lower case without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), 1)


def memory_terms() -> Column:
    """The words of both sides of a memory."""
    return F.concat(document_terms(F.coalesce("user_text", F.lit(""))), document_terms(F.coalesce("assist_text", F.lit(""))))


def indexed(memories: DataFrame, root: str | None = None, **options) -> Index:
    """An index of memories as its first batch, in a folder or in the scratch folder."""
    index = Index(root or scratch(memories.sparkSession, "index"), memory_terms(), **options)
    index.add(memories, 0)
    release(memories.sparkSession)
    return index


def asked(texts: DataFrame) -> DataFrame:
    """(query_id, agent_id, terms) of (query_id, agent_id, text)."""
    return texts.select("query_id", F.coalesce("agent_id", F.lit("")).alias("agent_id"), F.transform(query_terms(F.col("text")), F.lower).alias("terms"))


def bm25(texts: DataFrame, memories: DataFrame | Index, k: int) -> DataFrame:
    """(query_id, id, bm25, lexical_rank): the best k per query among visible memories; statistics are over all memories.

    A term counts once per occurrence in the query. Scores are negative, the least is the best. Memories that aren't indexed
    yet are indexed first.
    """
    index = memories if isinstance(memories, Index) else indexed(memories)
    found = index.search(asked(texts), k)
    return found.select("query_id", "id", (-F.col("score")).alias("bm25"), F.col("rank").alias("lexical_rank"))


def candidates(k: int) -> int:
    """How many of each kind are fused."""
    return max(50, 4 * k)


def fuse(texts: DataFrame, dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(query_id, rk, id, similarity, score, dense_top_similarity): reciprocal ranks summed.

    Queries without terms keep their dense ranks and scores.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    ours = dense.select("query_id", "id", F.col("rk").alias("d"), "similarity", F.col("score").alias("dense_score"), nothing("int").alias("l"), nothing("int").alias("terms"))
    theirs = lexical.select("query_id", "id", nothing("int").alias("d"), nothing("double").alias("similarity"), nothing("double").alias("dense_score"), F.col("lexical_rank").alias("l"), nothing("int").alias("terms"))
    asking = texts.select("query_id", nothing("long").alias("id"), nothing("int").alias("d"), nothing("double").alias("similarity"), nothing("double").alias("dense_score"), nothing("int").alias("l"), F.coalesce(F.size(query_terms(F.col("text"))), F.lit(0)).alias("terms"))
    # each side is computed once, and all that follows is by query
    of = ours.unionByName(theirs).unionByName(asking).repartition("query_id")
    both = of.groupBy("query_id", "id").agg(*(F.max(c).alias(c) for c in ("d", "similarity", "dense_score", "l", "terms")))
    query = Window.partitionBy("query_id")
    both = both.withColumn("terms", F.max("terms").over(query)).withColumn("dense_top_similarity", F.max(F.when(F.col("d") == 1, F.col("similarity"))).over(query))
    both = both.where("id IS NOT NULL AND terms IS NOT NULL").where((F.col("terms") > 0) | F.col("d").isNotNull())
    rrf = F.coalesce(1.0 / (rrf_k + F.col("d")), F.lit(0.0)) + F.coalesce(1.0 / (rrf_k + F.col("l")), F.lit(0.0))
    scored = both.withColumn("score", F.round(F.when(F.col("terms") > 0, rrf).otherwise(F.col("dense_score")), 9))
    found = scored.withColumn("rk", F.row_number().over(query.orderBy(F.desc("score"), "id"))).where(F.col("rk") <= k)
    return found.select("query_id", "rk", "id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "score", F.coalesce("dense_top_similarity", F.lit(0.0)).alias("dense_top_similarity"))
