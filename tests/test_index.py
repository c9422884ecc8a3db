"""The kept inverted index against plain BM25, through batches, removals, reruns and a rebuild."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import lexical
from anamnesis.operators.index import Index

WORDS = ["río", "Alpha", "beta", "gamma", "delta", "epsilon", "42", "z"]


def plain(memories, queries, k):
    """(query, id) -> rounded score and rank, over (id, agent, user, assistant)."""
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower().translate(str.maketrans(lexical.MARKED, lexical.PLAIN)))

    docs = {i: (a or "", words(u) + words(s)) for i, a, u, s in memories}
    n = len(docs)
    average = sum(len(w) for _, w in docs.values()) / n if n else 0
    df = Counter(t for _, w in docs.values() for t in set(w))
    out = {}
    for q, agent, text in queries:
        found = []
        for i, (a, w) in docs.items():
            if a and a != agent:
                continue
            tf, score = Counter(w), 0.0
            for t in re.findall("[A-Za-z0-9]+", text.lower()):
                if tf[t]:
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                    score += (idf if idf > 0 else 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / average))
            if round(score, 9) > 0:
                found.append((-round(score, 9), i))
        out |= {(q, i): (s, rank + 1) for rank, (s, i) in enumerate(sorted(found)[:k])}
    return out


def some(rng, ids):
    text = lambda most: " ".join(rng.choices(WORDS, weights=[1, 9, 5, 3, 2, 1, 1, 1], k=rng.randrange(most)))
    return [(i, rng.choice([None, "", "a", "b"]), rng.choice([None, text(12)]), text(20)) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, agent_id string, user_text string, assist_text string").withColumn("term", F.lit("extra"))


@pytest.mark.parametrize("span", [7, 100_000])
def test_index(spark, tmp_path, span):
    rng = random.Random(span)
    queries = [(q, ["", "a", "c"][q % 3], " ".join(rng.choices(WORDS, k=rng.randrange(5)))) for q in range(12)] + [(99, "a", "beta beta nothing"), (100, "", "")]
    texts = spark.createDataFrame(queries, "query_id long, agent_id string, text string")

    def check(index, memories, k=4):
        got = {(r.query_id, r.id): (r.bm25, r.lexical_rank) for r in lexical.bm25(texts, index, k).collect()}
        want = plain(memories, queries, k)
        assert {x: r for x, (_, r) in got.items()} == {x: r for x, (_, r) in want.items()}
        assert all(abs(got[x][0] - s) < 2e-9 for x, (s, _) in want.items())

    index = Index(f"file://{tmp_path}/index", lexical.memory_terms(), span=span)
    assert lexical.bm25(texts, index, 4).collect() == []
    lots = [some(rng, range(at, at + 40)) for at in (0, 40, 80)]
    index.add(frame(spark, lots[0]), 0)
    check(index, lots[0])
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    index.add(frame(spark, lots[1]), 1)
    index.add(frame(spark, lots[1]), 1)  # a batch that runs again
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # touches no other batch
    check(index, lots[0] + lots[1])
    gone = [r for r in lots[0] + lots[1] if r[0] % 3 == 0]
    changed = [(i, a, "alpha z z", s) for i, a, _, s in gone if i % 2]
    index.remove(frame(spark, gone), 2)
    index.add(frame(spark, changed + lots[2]), 2)  # some come back with other texts, in the same batch
    now = [r for r in lots[0] + lots[1] if r[0] % 3] + changed + lots[2]
    check(index, now)
    check(index, now, 1000)
    check(index.rebuild(spark, f"file://{tmp_path}/again"), now)


def test_blocks_are_ruled_out(spark, tmp_path):
    rows = [(i, None, "common " * (1 + (i < 20)) + ("rare " * 3 if i == 777 else "word " * (i % 7)), "") for i in range(1000)]
    index = lexical.indexed(frame(spark, rows), f"file://{tmp_path}/index", span=10)
    texts = spark.createDataFrame([(1, "", "rare common"), (2, "", "rare")], "query_id long, agent_id string, text string")
    got = {r.query_id: (r.blocks, r.scored) for r in index.ruled_out(lexical.asked(texts), 3).collect()}
    assert got[1][0] == 100 and got[1][1] < 40 and got[2] == (1, 1)
    assert lexical.bm25(texts.where("query_id = 1"), index, 1).first().id == 777


def test_no_rows_through_the_driver():
    """Neither the index nor its search takes rows to the driver or runs Python."""
    import inspect

    from anamnesis.operators import index

    code = inspect.getsource(index) + inspect.getsource(lexical)
    assert not re.search("toLocalIterator|collect\\(|mapInArrow|udf", code)


def test_pairs_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Many lots and steps find the same, with light terms of all shares, and no step shuffles pairs of query and memory."""
    from anamnesis.operators import index as module

    rng = random.Random(3)
    memories = some(rng, range(90))
    queries = [(q, ["", "a", "c"][q % 3], " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))) for q in range(20)]
    texts = spark.createDataFrame(queries, "query_id long, agent_id string, text string")
    plans, scored = [], module.Index._scored

    def noted(*args):
        found = scored(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(module.Index, "_scored", staticmethod(noted))
    monkeypatch.setattr(module, "CHUNK", 9)
    monkeypatch.setattr(module, "LOT", 60)
    monkeypatch.setattr(module, "FURTHER", 3)
    monkeypatch.setattr(module, "LIGHT", 0.9)
    held = lexical.indexed(frame(spark, memories), f"file://{tmp_path}/index")
    got = {(r.query_id, r.id): r.lexical_rank for r in lexical.bm25(texts, held, 3).collect()}
    assert got == {x: r for x, (_, r) in plain(memories, queries, 3).items()}
    assert len(plans) > 5 and not any(re.search(r"hashpartitioning\([^)]*\bquery_id#[^)]*\bid#|hashpartitioning\([^)]*\bid#[^)]*\bquery_id#", p) for p in plans)
