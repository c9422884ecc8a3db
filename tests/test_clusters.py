"""Searches over clusters find what a search of everything finds, and leave clusters out."""

import numpy as np
import pytest

from anamnesis.operators import retrieval
from anamnesis.operators.clusters import Clusters


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(12, size=600)] + 0.2 * rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [None, "a", "b", ""][i % 4], None if i % 97 == 3 else [0.0] * 16 if i % 97 == 4 else [1.0] if i % 97 == 5 else v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("most", [20_000, 7])
def test_same_results(spark, tmp_path, rows, most, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(retrieval, "MEMORY_CHUNK", 200)
    stored = spark.createDataFrame(rows, "id long, agent_id string, vector array<double>")
    kept = Clusters(f"file://{tmp_path}/kept", 12)
    queries = spark.createDataFrame([(i, ["", "a", "c"][i % 3], v or [0.0] * 16) for i, _, v in rows[::19] if v is None or len(v) == 16], "query_id long, agent_id string, query_emb array<double>")
    assert kept.alike(queries, 0.9).count() == 0 and kept.nearest(queries, 3, 0.5).count() == 0
    for number in (0, 1, 1):  # the last runs again
        kept.append(stored.where(f"id % 2 = {number}"), number)
    from anamnesis.functions.vector import normalised
    from pyspark.sql import functions as F

    whole = stored.where("size(vector) = 16").withColumn("agent_id", F.nullif("agent_id", F.lit(""))).select("id", "agent_id", F.lit(0.0).alias("created_at"), normalised(F.col("vector")).alias("user_emb")).where(F.exists("user_emb", lambda x: x != 0))
    real = queries.where(F.exists("query_emb", lambda x: x != 0))
    near = lambda found: sorted((r.query_id, r.id, round(r.similarity, 8)) for r in found.collect())
    assert near(kept.alike(queries, 0.93)) == near(retrieval.find_duplicates(real, whole, 0.93))
    assert near(kept.alike(queries, 0.93, before=1)) == near(retrieval.find_duplicates(real, whole.where("id % 2 = 0"), 0.93))
    want = retrieval.ranked(retrieval.best_pairs(real, whole, ["user_emb"], 5, 0.1, decay_days=None), 5)
    assert near(kept.nearest(queries, 5, 0.1)) == near(want) and want.count() > 100
    told = kept.skipped(real, 0.93).first()
    assert told.pairs == real.count() * whole.count() and told.scored < 0.3 * told.pairs


def test_reads_only_what_is_in_reach(spark, tmp_path, rows):
    stored = spark.createDataFrame([r for r in rows if r[2] and len(r[2]) == 16 and any(r[2])], "id long, agent_id string, vector array<double>")
    kept = Clusters(f"file://{tmp_path}/kept", 12)
    kept.append(stored, 0)
    one = stored.where("id = 0").selectExpr("id AS query_id", "'' AS agent_id", "vector AS query_emb")
    plan = kept.alike(one, 0.99)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cluster" in plan.split("PartitionFilters: [")[1].split("]")[0]
