"""Running sums of any size, ages by place, and the save path as a stream."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from anamnesis.functions import embedding
from anamnesis.functions.text import FACTS, sentence_spans
from anamnesis.functions.vector import normalised
from anamnesis.operators import messages, ordering, retrieval, store, study
from anamnesis.schema import SAVE_EVENTS
from anamnesis.sources.scratch import shared_root
from anamnesis.streaming.saving import Saver


@pytest.mark.parametrize("most", [0, 10**6])
def test_running_sums(spark, most):
    """Both plans give the sums of a plain loop, with a hot group, null groups and an empty table."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + [None, "b"]), rng.randrange(40), i, rng.randrange(9)) for i in range(700)]
    d = spark.createDataFrame(rows, "g string, x int, i int, v int").repartition(5)
    got = {(r.g, r.x, r.i): (r.n, r.s) for r in ordering.running_sums(d, ["g"], [F.desc("x"), F.col("i")], {"n": F.lit(1), "s": F.col("v") * 2}, most).collect()}
    n, s = {}, {}
    for g, x, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        n[g], s[g] = n.get(g, 0) + 1, s.get(g, 0) + 2 * v
        assert got.pop((g, x, i)) == (n[g], s[g])
    assert not got
    whole = ordering.running_sums(d, [], [F.col("i")], {"n": F.lit(1)}, most)
    assert [r.n for r in whole.orderBy("i").collect()] == [*range(1, 701)] and whole.columns == ["g", "x", "i", "v", "n"]
    assert ordering.running_sums(d.limit(0), ["g"], [F.col("i")], {"n": F.lit(1)}, most).count() == 0


def test_auroc_over_partitions(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), rng.random() < 0.3) for _ in range(400)]
    pairs = [(a > b) + 0.5 * (a == b) for a, p in rows if p for b, q in rows if not q]
    d = spark.createDataFrame(rows, "s double, e boolean")
    for most in (10**6, 0):
        monkeypatch.setattr(ordering, "MOST_ROWS", most)
        assert abs(study.auroc(d, "s", "e").first().auroc - np.mean(pairs)) < 1e-8


def test_dealt_queries_find_the_same(spark, monkeypatch):
    """Queries beyond the limit are dealt with memories over units of work; no unit changes a result."""
    rng = np.random.default_rng(5)
    rows = [(i, [None, "a", "b"][i % 3], 1.7e9 - 1000.0 * i, rng.standard_normal(6).tolist() if i % 17 else None, rng.standard_normal(6).tolist()) for i in range(300)]
    m = spark.createDataFrame(rows, "id long, agent_id string, created_at double, user_emb array<double>, assist_emb array<double>")
    m = m.select("id", "agent_id", "created_at", *(normalised(F.col(c)).alias(c) for c in ("user_emb", "assist_emb")))
    q = spark.createDataFrame([(i, ["", "a", "c"][i % 3], rng.standard_normal(6).tolist()) for i in range(70)], "query_id long, agent_id string, query_emb array<double>")
    find = lambda: sorted(map(tuple, retrieval.search(q, m, k=4, least=0.1).collect()))
    count = lambda: sorted(map(tuple, retrieval.count_pairs(q, m, ["user_emb"], [0.1, 0.5]).collect()))
    want, pairs = find(), count()
    assert len(want) > 150
    for cells, at_once in ((50, 7), (1 << 20, 2048)):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "COLUMNS_AT_ONCE", at_once)
        assert find() == want
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 16)
    monkeypatch.setattr(retrieval, "MEMORY_CHUNK", 90)
    assert find() == want and count() == pairs


def test_ages_by_place(spark):
    m = spark.createDataFrame([(5, "a", 1.0, 1.0), (3, "a", 1.0, 1.0), (4, "b", 7.0, 8.0)], "id long, agent_id string, created_at double, updated_at double")
    ages = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0)], "agent_id string, place long, age_hours double")
    got = {r.id: (r.created_at, r.updated_at) for r in store.positional_ages(m, ages, 10_000.0).collect()}
    assert got == {3: (2800.0, 2800.0), 5: (6400.0, 6400.0), 4: (7.0, 8.0)}
    for wrong in (ages.where("place = 1"), ages.union(spark.createDataFrame([("a", 3, 1.0)], ages.schema))):
        with pytest.raises(PySparkException, match="don't match"):
            store.positional_ages(m, wrong, 0.0).collect()


def test_request_keys(spark):
    rows = [(1, 0, "system", "Rules.\r\nCurrent date: 5 May\r\nMore."), (1, 1, "user", "first"), (1, 2, "user", "last"), (2, 0, "system", "no date"), (2, 1, "user", "x")]
    got = dict(map(tuple, messages.request_key(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert got == {1: "Current date: 5 May\nlast", 2: None}


def test_folder_off_local_mode():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf = Conf
        sparkContext = type("Context", (), {"master": "spark://elsewhere:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_root(Session)


def events(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 2, 6))
    rows = []
    for i in range(n):
        v = centres[int(rng.integers(len(centres)))] + 0.05 * rng.standard_normal(6)
        v = [float(x) for x in v / np.linalg.norm(v)]
        rows.append((i, [None, "a"][i % 2], 1.7e9 + i, f"The topic number {int(rng.integers(9))} came up on March {i % 28 + 1}, 2024. It was a long talk.", "A reply that is long enough. And a second sentence.", v, v))
    return rows


def test_save_path_restarts(spark, tmp_path):
    """A stream that stops and goes on over several batches ends with what one batch gives, and with what a plain loop gives."""
    rows = events(60, 3)
    extract = F.udf(lambda p: [{"subject": "talk", "attribute": f"topic{p.split('number ')[1][0]}", "value": p.split("March ")[1].split(",")[0]}], FACTS)
    embed = embedding.embedder(embedding.hashing_model(8))
    savers = [Saver(f"{tmp_path}/{name}", 0.9, embed=embed, extract=extract) for name in ("many", "one")]
    for lot in range(3):
        spark.createDataFrame(rows[20 * lot : 20 * lot + 20], SAVE_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        savers[0].start(spark, f"{tmp_path}/in", f"{tmp_path}/progress", files=1).awaitTermination()
    savers[1].save(spark.createDataFrame(rows, SAVE_EVENTS), 0)
    assert len(list((tmp_path / "many" / "memories").glob("batch=*"))) >= 3

    stored, times = {}, {}
    for i, agent, _, _, _, u, _ in rows:
        similar = [(-round(float(np.dot(np.float32(u), np.float32(x))), 9), j) for j, (g, x) in stored.items() if g is None or g == agent]
        best = min((x for x in similar if -x[0] >= 0.9), default=None)
        if best:
            times[best[1]] = times.get(best[1], 1) + 1
        else:
            stored[i] = agent, u
    for saver in savers:
        assert {r.id for r in saver.read(spark, "memories").collect()} == set(stored)
        touched = {r.id: r["count"] + 1 for r in saver.read(spark, "touches").groupBy("id").count().collect()}
        assert touched == times
        facts = sorted((r.attribute, r.value, r.id // 100) for r in saver.facts(spark).collect())
        assert facts == sorted((r.attribute, r.value, r.id // 100) for r in savers[1].facts(spark).collect()) and len(facts) > 20
        live = {r.id: r.access_count for r in saver.live(spark).collect()}
        assert live == {i: times.get(i, 1) for i in stored}
        spans = saver.sentences(spark).groupBy("memory_id").count().collect()
        assert {r.memory_id: r["count"] for r in spans} == {i: len(sentence_spans(rows[i][3])) + len(sentence_spans(rows[i][4])) for i in live}
        assert all(len(r.mentioned_days) == 1 for r in saver.live(spark).collect())
    # what was used least goes: the last use plus a day per access
    small = Saver(f"{tmp_path}/small", 0.9, per_agent=9, per_global=7)
    small.save(spark.createDataFrame(rows, SAVE_EVENTS), 0)
    last = {r.id: r.updated_at for r in savers[1].live(spark).collect()}
    best = {a: sorted((i for i in stored if stored[i][0] == a), key=lambda i: (-last[i] - 86400 * times.get(i, 1), -i))[:most] for a, most in ((None, 7), ("a", 9))}
    assert {r.id for r in small.live(spark).collect()} == {i for ids in best.values() for i in ids} and len(stored) > 16
    # a batch that runs again replaces what it wrote
    before = sorted(map(tuple, savers[1].read(spark, "touches").collect()))
    savers[1].save(spark.createDataFrame(rows, SAVE_EVENTS), 0)
    assert sorted(map(tuple, savers[1].read(spark, "touches").collect())) == before
    assert savers[1].live(spark, ttl_days=1, now=1.7e9 + 30 + 86400).count() == sum(i >= 30 for i in {r.id for r in savers[1].live(spark).collect()})


def test_backfill(spark):
    m = spark.createDataFrame([(i, 1.7e9, "A sentence of some length here. Another one of that kind.", "" if i == 2 else f"Reply with 2024-01-0{i + 1} in it.") for i in range(4)], "id long, created_at double, user_text string, assist_text string")
    whole = sorted(map(tuple, store.sentences(m).collect()))
    part = store.sentences(m).where("memory_id = 0 OR (memory_id = 1 AND side = 'u')")
    assert sorted(map(tuple, store.fill_sentences(m, part).collect())) == whole
    days = store.memory_days(m)
    assert sorted(map(tuple, store.fill_days(m, days.where("memory_id < 1")).collect())) == sorted(map(tuple, days.collect())) and days.count() == 3
