"""The evaluation table: questions, each with its own haystack of memories and evidence labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NOW
from ..operators import ranks
from ..operators.retrieval import best_pairs
from ..operators.study import line_tokens
from .scratch import kept, release
from .store import MEMORIES_SQL, created_at, exchanges, table, with_vectors


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question_type, query_emb, topic): the vectors whose ids are divisible by 50."""
    q = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return q.select(F.col("vec_id").alias("question_id"), F.concat(F.lit("type"), (F.col("label") % 3).cast("string")).alias("question_type"), F.col("embedding").alias("query_emb"), F.col("label").cast("long").alias("topic"))


def haystack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store, which is every question's haystack, with topic, age_hours, user_bytes, assist_bytes and tokens. Evidence has the question's topic; written."""
    vectors = table(spark, sf_dir, "embeddings")
    # only the lengths of texts are wanted, so no text is shuffled, and vectors come last
    e = exchanges(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.octet_length("text").alias("text")))
    e = e.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), created_at().alias("created_at"), F.col("user_text").alias("user_bytes"), F.col("assist_text").alias("assist_bytes"))
    m = e.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n"))))  # one row
    conv, turn = F.floor(F.col("id") / 1000), F.col("id") % 1000
    m = m.join(vectors.select(F.col("vec_id").alias("of"), F.col("label").cast("long").alias("topic")), F.col("of") == (conv * 37 + turn * 2) % F.col("n"))
    m = with_vectors(m, vectors).withColumn("age_hours", (F.lit(NOW) - F.col("created_at")) / 3600)
    m = m.select("id", "created_at", "user_emb", "assist_emb", "topic", "age_hours", "user_bytes", "assist_bytes", line_tokens().alias("tokens"))
    # in as many files as there are partitions: what follows is far more than what is read
    m = kept(m.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"), "haystack")
    release(spark)
    return m


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, id, raw, age_hours) of all pairs, as they are found in blocks."""

    def task(q, batch):
        ids, age = (ranks.column(batch, i) for i in (0, ranks.AGE))
        for asked, part, raw in ranks.blocks(q, batch):
            rows = np.repeat(q.ids[asked], len(part)), np.tile(ids[part], len(asked)), raw.ravel(), np.tile(age[part], len(asked))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["question_id", "id", "raw", "age_hours"])

    return ranks.meet(questions(spark, sf_dir), haystack(spark, sf_dir), task, "question_id long, id long, raw double, age_hours double")


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question_type, id, raw, age_hours, evidence, user_bytes, assist_bytes): all pairs, for what is asked of each of them.

    Questions meet memories in blocks, and only the similarities leave those.
    """
    q, m = questions(spark, sf_dir), haystack(spark, sf_dir)
    anyone = q.select(F.col("question_id").alias("query_id"), F.lit("").alias("agent_id"), "query_emb")
    pairs = best_pairs(anyone, m.withColumn("agent_id", F.lit(None).cast("string")), ["user_emb", "assist_emb"], 1 << 30, -2.0, decay_days=None, unit=True)
    pairs = pairs.select(F.col("query_id").alias("question_id"), "id", F.greatest("similarity", F.lit(-1.0)).alias("raw"))
    light = m.select("id", "age_hours", F.col("topic").alias("label"), "user_bytes", "assist_bytes")
    asked = q.select("question_id", "question_type", F.col("topic").alias("asked"))
    return pairs.join(light, "id").join(asked, "question_id").select("question_id", "question_type", "id", "raw", "age_hours", (F.col("label") == F.col("asked")).alias("evidence"), "user_bytes", "assist_bytes")


STUDY_SQL = f"""{MEMORIES_SQL}, study AS (
  SELECT q.vec_id AS question_id, concat('type', q.label % 3) AS question_type, m.id,
    round(greatest(list_cosine_similarity(q.embedding::DOUBLE[], m.user_emb::DOUBLE[]), list_cosine_similarity(q.embedding::DOUBLE[], m.assist_emb::DOUBLE[])), 9) AS raw,
    ({NOW} - m.created_at) / 3600 AS age_hours, v.label = q.label AS evidence, strlen(m.user_text) AS user_bytes, strlen(m.assist_text) AS assist_bytes
  FROM embeddings q CROSS JOIN memories m CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
  JOIN embeddings v ON v.vec_id = ((m.id // 1000) * 37 + (m.id % 1000) * 2) % n.n WHERE q.vec_id % 50 = 0)"""
