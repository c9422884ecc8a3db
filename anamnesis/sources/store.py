"""Sources: the stored conversations derived from plain tables, and readers for study data.

``MEMORIES_SQL`` and its fellows state the same derivations in SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exchanges(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it at once."""
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"))  # as in the SQL
    paired = conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("assist_text", F.lead("text").over(w))
    return paired.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user_text"), "assist_text")


def created_at() -> Column:
    return (1704067200 + (F.col("conv_id") * 7919 * 60) % 5400000 + F.col("turn") * 60).cast("double")


def with_vectors(m: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exchanges with the vectors of both sides; ``m`` has conv_id and turn, and n, the number of vectors."""
    u = vectors.select(F.col("vec_id").alias("u"), F.col("embedding").alias("user_emb"))
    a = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("assist_emb"))
    return m.join(u, (F.col("conv_id") * 37 + F.col("turn") * 2) % F.col("n") == F.col("u")).join(a, (F.col("conv_id") * 41 + F.col("turn") * 2 + 1) % F.col("n") == F.col("a"))


def memories(spark: SparkSession, sf_dir: str, text_only: bool = False) -> DataFrame:
    """The store: one row per exchange, with vectors unless ``text_only``."""
    agent = F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("agent"), (F.col("conv_id") % 4).cast("string")))
    m = exchanges(table(spark, sf_dir, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", agent.alias("agent_id"), created_at().alias("created_at"), "user_text", "assist_text",
        (1 + (F.col("conv_id") + F.col("turn")) % 3).cast("int").alias("access_count"))
    if text_only:
        return m.drop("conv_id", "turn")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = with_vectors(m.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n")))), vectors)  # one row
    return m.select("id", "agent_id", "created_at", "user_text", "assist_text", "access_count", "user_emb", "assist_emb")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, agent_id, query_emb): every vector whose id is divisible by 50; '' is the query without an agent."""
    turn = F.floor(F.col("vec_id") / 50) % 4
    agent = F.when(turn == 0, "").otherwise(F.concat(F.lit("agent"), turn.cast("string")))
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), agent.alias("agent_id"), F.col("embedding").alias("query_emb"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, agent_id, text): the user texts of memories whose id is divisible by 50."""
    m = memories(spark, sf_dir, text_only=True).where("id % 50 = 0")
    return m.select(F.col("id").alias("query_id"), F.coalesce("agent_id", F.lit("")).alias("agent_id"), F.col("user_text").alias("text"))


def fact_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, agent_id, subject, attribute, value, created_at, source_memory_id): orders' states as facts."""
    agent = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("agent"), (F.col("o_custkey") % 3).cast("string")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), agent.alias("agent_id"), F.concat(F.lit("Customer  "), F.col("o_custkey").cast("string")).alias("subject"), F.lit("order status").alias("attribute"),
        F.col("o_orderstatus").alias("value"), (F.lit(1704067200) + F.col("o_orderkey") % 5000000).cast("double").alias("created_at"), (F.col("o_orderkey") % 100 * 1000).alias("source_memory_id"))


def dated(m: DataFrame) -> DataFrame:
    """Memories with a date phrase at the end of the user text."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("id") % 5 + 1).cast("int"))
    return m.withColumn("user_text", F.concat("user_text", phrase))


PHRASES = [" They met 17 January 2024.", " See you yesterday", " Paid by 2024-02-11", "", " February 9, 2024 it is"]

EXCHANGES_SQL = """exchanges AS (SELECT * FROM (
  SELECT conv_id, turn, role, text AS user_text, lead(role) OVER w AS next_role, lead(text) OVER w AS assist_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""

MEMORIES_SQL = f"""{EXCHANGES_SQL}, memories AS (
  SELECT e.conv_id * 1000 + e.turn AS id, CASE WHEN conv_id % 4 <> 0 THEN concat('agent', conv_id % 4) END AS agent_id,
    CAST(1704067200 + (conv_id * 7919 * 60) % 5400000 + turn * 60 AS DOUBLE) AS created_at, user_text, assist_text,
    CAST(1 + (conv_id + turn) % 3 AS INTEGER) AS access_count, u.embedding AS user_emb, a.embedding AS assist_emb
  FROM exchanges e CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
  JOIN embeddings u ON u.vec_id = (conv_id * 37 + turn * 2) % n.n JOIN embeddings a ON a.vec_id = (conv_id * 41 + turn * 2 + 1) % n.n)"""

QUERIES_SQL = """queries AS (SELECT vec_id AS query_id, CASE WHEN vec_id // 50 % 4 = 0 THEN '' ELSE concat('agent', vec_id // 50 % 4) END AS agent_id, embedding AS query_emb
  FROM embeddings WHERE vec_id % 50 = 0)"""

TEXTS_SQL = "texts AS (SELECT id AS query_id, coalesce(agent_id, '') AS agent_id, user_text AS text FROM memories WHERE id % 50 = 0)"

FACTS_SQL = """fact_inputs AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 <> 0 THEN concat('agent', o_custkey % 3) END AS agent_id, concat('Customer  ', o_custkey) AS subject,
  'order status' AS attribute, o_orderstatus AS value, CAST(1704067200 + o_orderkey % 5000000 AS DOUBLE) AS created_at, o_orderkey % 100 * 1000 AS source_memory_id FROM orders)"""

DATED_SQL = f"""dated AS (SELECT * REPLACE (concat(user_text, [{', '.join(f"'{p}'" for p in PHRASES)}][id % 5 + 1]) AS user_text) FROM memories)"""


def preloaded(haystacks: DataFrame, now: float) -> DataFrame:
    """Haystacks (question_id, age_hours, user_text, assist_text, ...) as rows of a store: a question is an agent of its own."""
    at = F.lit(now) - F.col("age_hours") * 3600.0
    rest = [c for c in haystacks.columns if c not in ("question_id", "age_hours")]
    return haystacks.select(F.col("question_id").cast("string").alias("agent_id"), at.alias("created_at"), at.alias("updated_at"), *rest)


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question_type, question, asked, session_id, turn, role, content, evidence) from study records in JSON.

    A record has question_id, question_type, question, question_date, answer_session_ids, haystack_sessions,
    haystack_dates and haystack_session_ids.
    """
    turn = "array<array<struct<role:string,content:string,has_answer:boolean>>>"
    schema = f"question_id string, question_type string, question string, question_date string, answer_session_ids array<string>, haystack_sessions {turn}, haystack_dates array<string>, haystack_session_ids array<string>"
    r = spark.read.schema(schema).json(path, multiLine=True)
    sessions = r.select("question_id", "question_type", "question", study_time(F.col("question_date")).alias("asked"), "answer_session_ids", F.posexplode(F.arrays_zip("haystack_sessions", "haystack_dates", "haystack_session_ids")).alias("session", "s"))
    turns = sessions.select("*", F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return turns.select(
        "question_id", "question_type", "question", "asked", F.col("s.haystack_session_ids").alias("session_id"), study_time(F.col("s.haystack_dates")).alias("held"), "turn", "t.role", "t.content",
        (F.coalesce(F.col("t.has_answer"), F.lit(False)) | F.lit(False)).alias("evidence"), F.array_contains("answer_session_ids", F.col("s.haystack_session_ids")).alias("fallback"))


def study_time(text):
    """Times like '2023/05/30 (Tue) 23:40'."""
    return F.try_to_timestamp(F.regexp_replace(text, r" \(.*?\)", ""), F.lit("yyyy/MM/dd HH:mm"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
