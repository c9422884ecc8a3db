"""Collocations against plain counting."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from anamnesis.llm import collocations, lines
from anamnesis.llm.durable import ship
from anamnesis.llm.queries import ORACLES, QUERIES


def brute(rows, longest, least, inside, top):
    """Sorted rows of the contract, over (text, lang)."""
    f, out = {}, []
    for text, lang in rows:
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = tuple(re.findall("[^ \t]+", piece))
            own = f.setdefault("und" if lang is None else lang, Counter())
            own.update(w[i : i + k] for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        candidates = {p: c for p, c in own.items() if len(p) >= 2 and c >= least}
        found = []
        for p, a in candidates.items():
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in candidates.items()):
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, *options, n=3):
    d = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS doc_id", "'x' AS w1", "'y' AS phrase", "7L AS n", "0 AS bucket").repartition(n)
    return sorted(map(tuple, collocations.mine(d, *options).collect()))


@pytest.mark.parametrize(("longest", "least", "inside", "top"), [(3, 3, 50, 2000), (2, 2, 10, 5), (4, 4, 80, 40)])
@pytest.mark.parametrize("small", [False, True])
def test_against_counting(spark, monkeypatch, longest, least, inside, top, small):
    """Also with portions of a few bytes, many buckets and windows dealt at once."""
    ship(spark)
    if small:
        monkeypatch.setattr(lines, "AT_ONCE", 40)
        monkeypatch.setattr(collocations, "AT_ONCE", 40)
        monkeypatch.setattr(collocations, "BUCKET_BYTES", 200)
        monkeypatch.setattr(collocations, "DEALT_AT_ONCE", 3)
    r = random.Random(longest * 7 + least)
    words = ["The", "of", "new", "york", "Ärger", "ÉTÉ", "日本", "x" * 300, "a\x00b", "\xa0", "it's", '"q"', "é"]
    make = lambda: "".join(r.choice(words[: r.choice([4, 13])]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " - "]) for _ in range(r.randrange(25)))
    rows = [(make(), r.choice(["en", "en", "fr", None, "", "two words\n"])) for _ in range(60)] + [(None, "en"), ("", "de"), (" . , ", "de"), ("new york " * 400, "es")]
    rows += [rows[0]] * 5
    if small:
        rows = rows[:25] + rows[-6:]
    want = brute(rows, longest, least, inside, top)
    assert mined(spark, rows, longest, least, inside, top) == want and want


def test_tables_without_candidates(spark, nothing, documents):
    ship(spark)
    assert collocations.mine(nothing).collect() == []
    assert mined(spark, [("one two three", "en"), (None, None)]) == []
    rows = [(x.text, x.lang) for x in documents.select("text", "lang").collect()]
    assert sorted(map(tuple, collocations.mine(documents).collect())) == brute(rows, 3, 10, 50, 2000)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 9 * 10**14), ("en", "a", 1, 3 * 10**15), ("en", "b", 1, 10**15)], "lang string, phrase string, size int, f long")
    row = collocations.cut_scores(counts, 3).first()
    assert row.score == 10**6 * 9 * 10**14 * 9 * 10**14 // (3 * 10**15 * 10**15) == 270_000


def test_words_of_a_batch():
    texts = pa.array(["One  two", None, "three", "", "four.five six"]).slice(0)
    found, rows, pieces = collocations.words(texts)
    assert found.to_pylist() == ["one", "two", "three", "four", "five", "six"] and rows.tolist() == [0, 0, 2, 4, 4, 4] and len(set(pieces.tolist())) == 4
    assert collocations.words(texts.slice(2, 2))[0].to_pylist() == ["three"] and len(collocations.words(texts.slice(1, 1))[0]) == 0
    assert [*lines.portions(texts, 6)] == [(0, 1), (1, 4), (4, 5)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
        want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLES['op12_collocations']})").fetchall()
    got = QUERIES["op12_collocations"](spark, d)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
