"""Cases of a review: inputs on which results once differed from the SQL."""

import math
import re

import duckdb
import numpy as np

from anamnesis.operators import retrieval
from anamnesis.plans import catalog
from anamnesis.streaming import ingest

EVENTS = "id long, agent_id string, created_at double, user_text string, assist_text string, user_emb array<float>, assist_emb array<float>"


def against_sql(spark, tmp_path, name, **tables):
    """A query over small tables against its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert rows and sorted(rows, key=repr) == sorted(want, key=repr)


def test_conversations_that_begin_alike(spark, tmp_path):
    """Only those with a block of their own get one."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for c in range(4) for t in range(6)]
    against_sql(spark, tmp_path, "sticky_history", conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_thresholds_are_not_rounded(spark):
    """A pair that is a ten-billionth short of a threshold isn't counted."""
    q = spark.createDataFrame([(0, "", [1.0, 0.0])], "query_id long, agent_id string, query_emb array<double>")
    short, enough = 0.5 - 1e-10, 0.5 + 1e-10
    m = spark.createDataFrame([(i, None, 0.0, [s, (1 - s * s) ** 0.5]) for i, s in enumerate((short, enough))], "id long, agent_id string, created_at double, user_emb array<double>")
    assert [tuple(r) for r in retrieval.count_pairs(q, m, ["user_emb"], [0.5]).collect()] == [(0.5, 1)]


def test_a_pair_at_a_threshold_is_summed_in_order(spark, tmp_path):
    """Its similarity is 0.4999999999999999 in the SQL's order and 0.5 if the query is made a unit vector first."""
    vectors = [(0, [3.0, 4.0]), (1, [0.7, 0.1]), (2, [0.7, 0.1])]
    talk = [(8, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(2)]
    against_sql(
        spark, tmp_path, "score_threshold", conversations=spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"),
        embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))


def test_a_long_vector_at_a_threshold_is_summed_in_order(spark):
    """The longer a stored vector, the more the order of its sum changes; each threshold here is one pair's own similarity."""
    rng = np.random.default_rng(5)
    asked, held = rng.normal(size=16), rng.normal(size=(40, 16)) * 1e6
    def dot(a, b):
        total = 0.0
        for x, y in zip(a.tolist(), b.tolist()):
            total += x * y
        return total

    base = [dot(asked, v) / math.sqrt(dot(asked, asked)) for v in held]
    q = spark.createDataFrame([(0, "", asked.tolist())], "query_id long, agent_id string, query_emb array<double>")
    m = spark.createDataFrame([(i, None, 0.0, v.tolist()) for i, v in enumerate(held)], "id long, agent_id string, created_at double, user_emb array<double>")
    got = retrieval.count_pairs(q, m, ["user_emb"], base).collect()
    assert sorted(map(tuple, got)) == [(x, len(base) - i) for i, x in enumerate(sorted(base))]


def test_similarities_that_are_no_numbers(spark, tmp_path):
    """Vectors of length zero, with infinite components or NaN, or missing, as queries (0, 50, ...) and in the store: as in the SQL."""
    odd = {0: [0.0, 0.0], 7: [0.0, 0.0], 8: [math.inf, 0.1], 9: [-math.inf, 0.1], 10: [math.nan, 0.1], 11: None, 50: [math.inf, 1.0], 100: [math.nan, 1.0], 150: None, 200: [1e-30, 1e-30]}
    vectors = [(i, odd.get(i, [math.cos(i * 1.3), math.sin(i * 1.3)])) for i in range(260)]
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for c in range(60) for t in range(4)]
    against_sql(
        spark, tmp_path, "score_threshold", conversations=spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"),
        embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))


def test_a_reply_without_a_turn_comes_last(spark, tmp_path):
    """So it answers the last question, as in the SQL."""
    talk = [(8, 0, "user", "a"), (8, None, "assistant", "b"), (9, 0, "user", "a"), (9, 1, "assistant", "b")]
    against_sql(
        spark, tmp_path, "score_threshold", conversations=spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"),
        embeddings=spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "vec_id long, embedding array<float>"))


def test_a_task_leaves_the_best_k_of_all_its_batches(spark, monkeypatch):
    """Of many batches k rows a query, not k of each batch; the best of all stay the best, with what is held handed on or not, broadcast or dealt."""
    q = spark.createDataFrame([(i, "", [1.0, float(i)]) for i in range(3)], "query_id long, agent_id string, query_emb array<double>")
    m = spark.createDataFrame([(i, "a" if i % 3 == 0 else None, 0.0, [math.cos(i % 60 / 40), math.sin(i % 60 / 40)]) for i in range(200)], "id long, agent_id string, created_at double, user_emb array<double>").coalesce(1)
    find = lambda: retrieval.best_pairs(q, m, ["user_emb"], 2, 0.1)
    want = sorted(map(tuple, retrieval.ranked(find(), 2).collect()))
    assert len(want) == 6
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert find().count() == 6
        monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 2)
        assert sorted(map(tuple, retrieval.ranked(find(), 2).collect())) == want
        assert sorted(_handed_on()) == [(0, 0, 9.0), (0, 1, 9.0), (1, 2, 8.0), (1, 11, 9.0)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _handed_on():
    """(query, id, score) that a task holds after two additions; the first fills query 0."""
    best = retrieval.Best(retrieval.Queries([0, 1], ["", ""], [[1.0], [1.0]]), 2)
    best.AT_ONCE = 3
    rows = lambda *x: (*(np.array(c, t) for c, t in zip(zip(*x), (int, np.int64, float, float))),)
    got = list(best.add(*rows((0, 5, 0.0, 9.0), (0, 1, 0.0, 9.0), (0, 0, 0.0, 9.0), (1, 2, 0.0, 8.0))))
    assert not got and best.reached[0] == 9.0 and best.reached[1] == -np.inf
    got += [*best.add(*rows((1, 11, 0.0, 9.0))), *best.rest()]
    return [(r["query_id"], r["id"], r["score"]) for b in got for r in b.to_pylist()]


def test_hybrid_search_scores_dense_pairs_once(spark, tmp_path):
    """The dense ranks and the similarity of the first come from one search; the result is that of the SQL."""
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"word{c % 3} of {t} and {c}" if c % 5 else "--") for c in range(12) for t in range(4)]
    vectors = [(i, [math.cos(i * 1.3), math.sin(i * 1.3)]) for i in range(30)]
    against_sql(
        spark, tmp_path, "hybrid_rrf", conversations=spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"),
        embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    plan = catalog.QUERIES["hybrid_rrf"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1


def test_equal_vectors_under_a_threshold_that_nothing_reaches(spark):
    """All go in; with one that they reach, the first."""
    rows = spark.createDataFrame([(i, "a", float(i), "t", "t", [0.6, 0.8], [0.6, 0.8]) for i in range(4)], EVENTS)
    for threshold, new in ((2.0, {0, 1, 2, 3}), (0.92, {0})):
        inserted, touches = ingest.resolve(rows.limit(0), rows, threshold)
        assert {r.id for r in inserted.collect()} == new and touches.count() == 4 - len(new)


def test_a_reply_does_not_stand_beside_its_chunks(spark, tmp_path):
    """Chunks are cut in one pass, whatever the length: no plan carries the body through an explosion, and nothing is lost."""
    from anamnesis.plans import context

    rows = [(1, 1, "assistant", "word é 🙂 " * 400), (2, 1, "assistant", ""), (3, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    chunks = context.reply_chunks(spark, str(tmp_path))
    assert "substring" not in chunks._jdf.queryExecution().toString()
    assert {r.stream_id: r.text for r in context.messages.reply_of_chunks(chunks).collect()} == {1001: rows[0][3], 2001: ""}
