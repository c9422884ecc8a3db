import random
import re

import numpy as np
import pytest
import xxhash

from anamnesis.llm import embeddings, simhash
from anamnesis.llm.components import connected_components
from anamnesis.llm.durable import ship
from tests.llm.conftest import ROWS


def components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(0, i) for i in range(300, 400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(600, pairs)
    assert all(want[n] == c for n, c in got.items()) and set(got) == {x for a, b in pairs if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in [t for _, t, *_ in ROWS if t != ROWS[6][1]] + ["A b\x1cC d", "ÀB c d e", "one two", "x\x0by\x0cz w"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_links_of_dense_groups(spark):
    """Groups of near fingerprints, over many small tiles, give the components of all pairs."""
    ship(spark)
    rng = np.random.default_rng(2)
    base = np.repeat(rng.integers(0, 1 << 63, 120).astype(np.uint64), 12)
    noise = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in base], np.uint64)
    fp = np.unique(np.concatenate([base ^ noise, rng.integers(0, 1 << 63, 500).astype(np.uint64), np.array([0, 1], np.uint64)]))
    distance = np.bitwise_count(fp[:, None] ^ fp[None])
    want = components(len(fp), [(i, j) for i, j in zip(*np.nonzero(distance <= 3)) if i < j])
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    links = [(r.a, r.b) for r in simhash.links(nodes, 3, tile=16).collect()]
    place = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    assert components(len(fp), [(place[a], place[b]) for a, b in links]) == want


def test_near_duplicates_of_odd_rows(documents, nothing):
    got = simhash.near_duplicates(documents).collect()
    assert len(got) == len(ROWS)
    fp = [brute_fingerprint(t) if i != 6 else simhash.fingerprint(t) for i, t, *_ in ROWS]
    want = components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 3])
    least = {}
    for (i, *_), c in zip(ROWS, want):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    expected = sorted(((i, f - (1 << 64) if f >> 63 else f, least.get(c)) for (i, *_), f, c in zip(ROWS, fp, want)), key=str)
    assert sorted(map(tuple, got), key=str) == expected
    assert simhash.near_duplicates(nothing).count() == 0


def brute_links(rows, least):
    unit = []
    for _, v, label in rows:
        good = v is not None and label is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        x = np.array(v, np.float32).astype(float) if good else None
        unit.append(None if x is None else x / np.sqrt(x @ x))
    ok = lambda i, j: unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least
    return [(i, j) for i in range(len(rows)) for j in range(i) if ok(i, j)]


@pytest.mark.parametrize(("tile", "kind", "options"), [(8, "float", {}), (1024, "double", {"window": 8}), (16, "double", {"exact": True})])
def test_vectors(spark, tile, kind, options):
    ship(spark)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    near = [c + 0.04 * rng.standard_normal(16) for c in centres for _ in range(int(rng.integers(1, 14)))]
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(near)]
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * 16, 1), (1005, [1.0, None] * 8, 0), (1006, [float("nan")] * 16, 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [], 1), (1010, [float("inf")] * 16, 1)]
    d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'z' AS v", "'z' AS node", "'z' AS pass", "'z' AS copies", "'z' AS grp").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_duplicates(d, tile=tile, **options).collect()}
    pairs = brute_links(rows, 0.93)
    degree, want = np.zeros(len(rows), int), components(len(rows), pairs)
    for i, j in pairs:
        degree[i] += 1
        degree[j] += 1
    assert len(got) == len(rows)
    for k, (i, *_) in enumerate(rows):
        assert (got[i].n_links, got[i].component_id) == (degree[k], rows[want[k]][0]) and got[i].kept == (i == rows[want[k]][0])
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_doubles_and_repeated_ids(spark):
    """Components beyond single precision keep their values, and an id may have several vectors."""
    ship(spark)
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, -1e200], 0), (3, [1e-300, 1e-300], 0), (4, [1.0, 1.0 + 1e-12], 0), (5, [1.0, -1.0], 0), (5, [0.0, 1.0], 0), (6, [1.0, 0.0], None), (6, [1.0, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 1, 2), (3, 2, 1), (4, 2, 1), (5, 0, 5), (5, 1, 2), (6, 0, 6), (6, 0, 6)]


def test_passes_meet_what_they_promise(spark):
    """One large label with pairs right above the threshold, with a small window: rounds find all that exact tiles find."""
    ship(spark)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((3000, 32))
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.931, 0.97, (3000, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * off]))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    want = {r.vec_id: r.component_id for r in embeddings.near_duplicates(d, exact=True).collect()}
    assert sum(i != c for i, c in want.items()) >= 3000
    assert {r.vec_id: r.component_id for r in embeddings.near_duplicates(d, window=64).collect()} == want
    assert embeddings.passes_for(64, 0.93, 64) == 1 < embeddings.passes_for(10**4, 0.93) < embeddings.passes_for(10**6, 0.93)
