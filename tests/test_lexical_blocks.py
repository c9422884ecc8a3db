"""BM25 of many queries in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import lexical_blocks
from anamnesis.operators.index import Index
from tests.test_index import WORDS, frame, plain, some
from tests.test_review import against_sql


@pytest.mark.parametrize("shared", [0.0, 0.3, 2.0])
def test_lots_and_rounds(spark, monkeypatch, shared):
    """Whatever the lots, the rounds, the blocks, and the words that are multiplied, the best are found with the scores of plain BM25."""
    rng = random.Random(5)
    memories = some(rng, range(150))
    queries = [(q, ["", "a", "c"][q % 3], " ".join(rng.choices([*WORDS, "Beta", "nothing"], k=rng.randrange(1, 9)))) for q in range(30)] + [(99, "a", ""), (100, "b", None)]
    texts = spark.createDataFrame(queries, "query_id long, agent_id string, text string")
    for name, value in {"TERMS": 40, "LOT": 4, "LEAST_LOT": 2, "CELLS": 8, "SHARED": shared, "ADDED": 5}.items():
        monkeypatch.setattr(lexical_blocks, name, value)
    for k in (3, 1000):
        got = {(r.query_id, r.id): (r.bm25, r.lexical_rank) for r in lexical_blocks.bm25(texts, frame(spark, memories), k).collect()}
        want = plain(memories, [(q, a, t or "") for q, a, t in queries], k)
        assert {x: r for x, (_, r) in got.items()} == {x: r for x, (_, r) in want.items()}
        assert all(abs(got[x][0] - s) < 2e-9 for x, (s, _) in want.items())
    assert lexical_blocks.bm25(texts, frame(spark, memories).limit(0), 3).collect() == [] == lexical_blocks.bm25(texts.limit(0), frame(spark, memories), 3).collect()


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    rows = [(i, None, "alpha beta" if i % 2 else "gamma", "") for i in range(9)]
    texts = spark.createDataFrame([(0, "", "gamma")], "query_id long, agent_id string, text string")
    real = lexical_blocks.hashed
    monkeypatch.setattr(lexical_blocks, "hashed", lambda term, salt: F.length(term).cast("long") if salt == 0 else real(term, salt))
    assert sorted(r.id for r in lexical_blocks.bm25(texts, frame(spark, rows), 9).collect()) == [0, 2, 4, 6, 8]


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_rrf"])
def test_all_first_turns_as_queries(spark, tmp_path, monkeypatch, name):
    """Postings aren't dealt anew for lots of queries, as they are where an index is searched; rows are those of the SQL."""
    monkeypatch.setattr(Index, "search", lambda *a: pytest.fail("an index is searched"))
    rng = random.Random(8)
    say = lambda: " ".join(rng.choices(WORDS, weights=[1, 9, 5, 3, 2, 1, 1, 1], k=rng.randrange(1, 14)))
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", say()) for c in range(60) for t in range(4)]
    vectors = [(v, [rng.gauss(0, 1) for _ in range(8)], v % 5) for v in range(90)]
    unit = F.transform("e", lambda x: (x / F.sqrt(F.aggregate("e", F.lit(0.0), lambda t, y: t + y * y))).cast("float"))
    embeddings = spark.createDataFrame(vectors, "vec_id long, e array<double>, label int").select("vec_id", unit.alias("embedding"), "label")
    against_sql(spark, tmp_path, name, conversations=spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"), embeddings=embeddings)
