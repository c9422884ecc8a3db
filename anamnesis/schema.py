"""Schemas of the store's tables."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

MEMORIES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("agent_id", T.StringType()), T.StructField("created_at", T.DoubleType()),
    T.StructField("updated_at", T.DoubleType()), T.StructField("user_text", T.StringType()), T.StructField("assist_text", T.StringType()),
    T.StructField("user_emb", VECTOR), T.StructField("assist_emb", VECTOR), T.StructField("access_count", T.IntegerType()),
])

FACTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("agent_id", T.StringType()), T.StructField("subject", T.StringType()),
    T.StructField("attribute", T.StringType()), T.StructField("value", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("source_memory_id", T.LongType()), T.StructField("created_at", T.DoubleType()), T.StructField("superseded_by", T.LongType()),
    T.StructField("embedding", VECTOR),
])

SENTENCES = T.StructType([
    T.StructField("memory_id", T.LongType()), T.StructField("side", T.StringType()), T.StructField("idx", T.IntegerType()),
    T.StructField("start_byte", T.IntegerType()), T.StructField("end_byte", T.IntegerType()), T.StructField("embedding", VECTOR),
])

SAVE_EVENTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("agent_id", T.StringType()), T.StructField("created_at", T.DoubleType()),
    T.StructField("user_text", T.StringType()), T.StructField("assist_text", T.StringType()), T.StructField("user_emb", VECTOR), T.StructField("assist_emb", VECTOR),
])
