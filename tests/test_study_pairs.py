"""All pairs of the study: what is shuffled for them, and how they are rounded."""

import duckdb
from pyspark.sql import functions as F

from anamnesis.plans import study as plans
from anamnesis.sources import study as source


def test_no_text_is_shuffled(spark, tmp_path, monkeypatch):
    """Lengths are taken before exchanges are paired, so windows and joins carry no texts."""
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", "ü" * (c + t) if c else None) for c in range(3) for t in range(4)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(v, [1.0, float(v)], v % 2) for v in range(100)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan, kept = [], source.kept
    monkeypatch.setattr(source, "kept", lambda df, name: (plan.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, name))[1])
    got = {r.id: (r.user_bytes, r.assist_bytes, r.topic, r.user_emb[1], r.assist_emb[1]) for r in source.haystack(spark, str(tmp_path)).collect()}
    length = lambda c, t: 2 * (c + t) if c else None
    assert got == {c * 1000 + t: (length(c, t), length(c, t + 1), (c * 37 + t * 2) % 2, c * 37 + t * 2, c * 41 + t * 2 + 1) for c in range(3) for t in (0, 2)}
    assert len(plan) == 1 and plan[0].index("octet_length") > plan[0].index("Window")  # a child comes after its parents


def test_halfway_scores(spark, monkeypatch):
    """Scores halfway between millionths are rounded as the SQL rounds them."""
    rows = spark.range(20_000).select(F.lit(0).cast("long").alias("question_id"), "id", ((F.col("id") * 37 + 0.5) / 1e6).alias("raw"), (F.col("id") % 500).cast("double").alias("age_hours"))
    monkeypatch.setattr(plans, "similarities", lambda spark, d: rows)
    got = sorted(map(tuple, plans.score_variants(spark, "").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE study AS SELECT 0::BIGINT AS question_id, range AS id, (range * 37 + 0.5::DOUBLE) / 1e6::DOUBLE AS raw, (range % 500)::DOUBLE AS age_hours FROM range(20000)")
    sql = plans.R.oracles["score_variants"]
    assert got == sorted(con.sql(sql[sql.index("SELECT question_id, id, raw, round(round(") :]).fetchall())
