"""Order-dependent de-duplication by components against the plain loop."""

import math
import random

import numpy as np
import pytest

from anamnesis.operators import retrieval
from anamnesis.operators.components import components, joined
from anamnesis.streaming import ingest

SCHEMA = "id long, agent_id string, created_at double, user_text string, assist_text string, user_emb array<double>, assist_emb array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, a, float(i), "t", "t", v, v) for i, a, v in rows], SCHEMA)


def plain(stored, rows, threshold):
    """(ids that go in, {by: touched}) of (id, agent, unit vector) in order."""
    held, touched, new = list(stored), {}, set()
    for i, agent, v in rows:
        found = [(-round(float(np.dot(v, x)), 9), j) for j, a, x in held if v is not None and x is not None and (not a or a == agent)]
        best = min((f for f in found if -f[0] >= threshold), default=None)
        if best:
            touched[i] = best[1]
        else:
            held.append((i, agent, v))
            new.add(i)
    return new, touched


def check(spark, stored, rows, threshold):
    inserted, touches = ingest.resolve(frame(spark, stored), frame(spark, rows), threshold)
    new, touched = plain(stored, rows, threshold)
    assert {r.id for r in inserted.collect()} == new and {r.by: r.id for r in touches.collect()} == touched
    return new, touched


@pytest.mark.parametrize("most_alike", [16, 2])
@pytest.mark.parametrize("most_links", [10**6, 3])
def test_random_batches(spark, monkeypatch, most_alike, most_links):
    """With groups of near copies, equal rows, agents, nulls, and both ways of settling."""
    monkeypatch.setattr(ingest, "MOST_ALIKE", most_alike)
    monkeypatch.setattr(ingest, "MOST_LINKS", most_links)
    rng, r = np.random.default_rng(most_alike + most_links), random.Random(1)
    centres = rng.standard_normal((9, 3))
    rows = []
    for i in range(160):
        v = centres[0 if r.random() < 0.3 else r.randrange(9)] + 0.25 * rng.standard_normal(3)
        v = [float(x) for x in v / np.linalg.norm(v)]
        if rows and r.random() < 0.15:
            v = r.choice(rows)[2]
        rows.append((i, r.choice([None, "a", "b"]), None if i % 23 == 5 else v))
    new, _ = check(spark, rows[:30], rows[30:], 0.95)
    assert 20 < len(new) < 110


def test_chain_takes_as_many_passes_as_a_pair(spark, monkeypatch):
    """A chain of 5,000 links: vectors are compared with the store, with each other, and with what went in, once each."""
    passes, once = [], retrieval.best_pairs
    monkeypatch.setattr(retrieval, "best_pairs", lambda *a, **k: passes.append(1) or once(*a, **k))
    angle = 2 * math.pi / 5001  # on a circle that is open at its end, each is alike only to the one before and the one after
    rows = [(i, None, [math.cos(angle * i), math.sin(angle * i)]) for i in range(5000)]
    new, touched = check(spark, [], rows, math.cos(1.5 * angle))
    assert len(passes) == 3 and len(new) == 2500 and len(touched) == 2500


def test_components(spark):
    r = random.Random(3)
    for n, m in ((200, 150), (50, 400)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        want = {x: find(x) for a, b in links if a != b for x in (a, b)}
        got = {row.id: row.component for row in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
        assert got == want
        a, b = (np.array(x) for x in zip(*links))
        assert dict(zip(*(x.tolist() for x in joined(a, b)))) == {x: find(x) for ab in links for x in ab}
    path = spark.range(3000).selectExpr("id AS a", "id + 1 AS b").repartition(5)
    assert {row.component for row in components(path).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
