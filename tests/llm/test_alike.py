import random

import numpy as np
import pytest

from anamnesis.llm import alike
from anamnesis.llm.durable import ship
from tests.llm.test_duplicates import components


def word_sets(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def copies():
    """Texts of different length, their copies with words replaced, and a long passage that many share."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, rows = [word() for _ in range(60)], []
    for size in (1, 4, 5, 6, 9, 40, 120, 300, 700):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for changes in (0, 0, 1, 2, 3, 5, 7):
                text = list(base)
                for i in rng.sample(range(size), min(size, changes)):
                    text[i] = word()
                rows.append(" ".join(text))
    rows += [" ".join([*passage, *(word() for _ in range(k))]) for k in range(2, 30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("tile", "tile_shingles"), [(8192, 300_000), (8, 500)])
def test_every_pair_of_likeness_is_linked(spark, monkeypatch, tile, tile_shingles):
    ship(spark)
    monkeypatch.setattr(alike, "TILE_SHINGLES", tile_shingles)
    rows = copies()
    sets = [word_sets(t) for _, t in rows]
    like = [(i, j, jaccard(sets[i], sets[j])) for i in range(len(rows)) for j in range(i)]
    assert sum(0.8 <= x < 0.95 for *_, x in like) > 20 and sum(0.6 < x < 0.8 for *_, x in like) > 20
    want = components(len(rows), [(i, j) for i, j, x in like if x >= 0.8])
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in alike.near_copies(d, tile=tile).collect()} == dict(enumerate(want))
    kept = alike.drop_near_copies(d, tile=tile)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_rows_that_share_an_id(spark):
    """An id with two texts keeps both; equal rows, with or without an id, leave one."""
    ship(spark)
    rows = [(1, "one two three four five six"), (1, "another text of seven words it is"), (2, "one two three four five six"), (3, "repeated row of more than five words"), (3, "repeated row of more than five words"),
            (None, "no id but a text of its own"), (None, "no id but a text of its own"), (None, "Repeated ROW of more than five words")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS k1", "'z' AS node", "'z' AS size", "'z' AS component", "'z' AS _k1")
    kept = alike.drop_near_copies(d)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted({rows[i] for i in (0, 1, 3, 5)}, key=str)
    assert alike.drop_near_copies(d.limit(0)).count() == 0 and alike.near_copies(d.limit(0)).count() == 0


def test_distance_tells_likeness():
    """The radius covers texts at the threshold; sets without anything in common are far apart."""
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    near, whole, first = 0, alike.radius_of(0.8), alike.radius_of(0.8, 64)
    for _ in range(400):
        n = int(rng.integers(20, 400))
        both = draw(8 * n)
        a, b = (alike.wide_print(np.unique(np.concatenate([both, draw(n)]))) for _ in range(2))  # similarity 0.8
        apart = np.bitwise_count(a ^ b)
        near += apart.sum() <= whole and apart[0] <= first
    assert near >= 395
    assert min(np.bitwise_count(alike.wide_print(draw(50)) ^ alike.wide_print(draw(50))).sum() for _ in range(400)) > whole


def test_prints_of_long_and_short_sets():
    for grams in (np.array([7], np.uint64), np.arange(254, dtype=np.uint64), np.arange(255, dtype=np.uint64), np.arange(70_000, dtype=np.uint64)):
        h = alike.mix(grams[:, None] + alike.SALTS)
        bits = [2 * int(((h[:, k] >> np.uint64(b)) & np.uint64(1)).sum()) > len(grams) for k in range(alike.WORDS) for b in range(64)]
        assert np.unpackbits(alike.wide_print(grams).view(np.uint8), bitorder="little").astype(bool).tolist() == bits
