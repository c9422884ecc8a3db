"""Alignment of two tokenizers against a plain version with both libraries on whole texts."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from anamnesis.llm import alignment
from anamnesis.llm.durable import ship
from anamnesis.llm.queries import QUERIES
from anamnesis.llm.queries import vocab as path

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, libraries):
    """Both lists of (id, bytes) of a text, whole; empty if their bytes aren't the text."""
    a, b = libraries
    if not text:
        return [], []
    spelled = alignment.byte_alphabet()
    left = [(i, bytes(spelled[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    right = [(i, piece(i)) for i in b.encode(text)]
    want = f" {text}".encode()
    return (left, right) if all(b"".join(x for _, x in side) == want for side in (left, right)) else ([], [])


def spans(side):
    ends = np.cumsum([len(x) for _, x in side]).tolist()
    return list(zip([0, *ends], ends))


def brute(rows, libraries):
    """The contract's columns of (key, text) rows, in order."""
    held, counts = [], defaultdict(int)
    for _, text in rows:
        left, right = tokens(text, libraries)
        x, y = spans(left), spans(right)
        links = [(left[i][0], right[j][0]) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if s < f and t < e] if len(x) < 400 else sweep(left, right, x, y)
        cuts = sorted({e for _, e in x} & {e for _, e in y})
        groups = [",".join(str(i) for (i, _), (s, e) in zip(left, x) if lo <= s < hi) + "|" + ",".join(str(i) for (i, _), (s, e) in zip(right, y) if lo <= s < hi) for lo, hi in zip([0, *cuts], cuts)] if len(x) < 400 else None
        held.append((left, right, len(cuts), links, groups))
        for p in set(links):
            counts[p] += 1
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for (key, _), (left, right, n, links, groups) in zip(rows, held):
        digest = None if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield key, len(left), len(right), n, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest


def sweep(left, right, x, y):
    i = j = 0
    out = []
    while i < len(x) and j < len(y):
        out.append((left[i][0], right[j][0]))
        e, f = x[i][1], y[j][1]
        i, j = i + (e <= f), j + (f <= e)
    return out


def same(got, want):
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert tuple(r)[: 7] == w[:7] and (w[7] is None or r[7] == w[7]), (r, w)


def test_query(spark, libraries):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in pd.read_parquet(f"{d}/documents.parquet").itertuples()]
    got = sorted(QUERIES["op11_alignment"](spark, d).collect(), key=lambda r: r.doc_id)
    assert got[0].__fields__[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(got, sorted(brute(rows, libraries)))


ODD = [None, "", " ", "  ", "a  b ", "▁x", "a▁ b", "<s> </s> <unk> <0x41> <|endoftext|>", "a\x00b \x00", "\xa0x \xa0 y　 z", "\n x\n\n  y\t z \n", "日本語 テキスト です", "🙂🙃 é ñ ß", "naïve café Ærø", "don't  can't 'll 12 3456 7,8", "ab" * 300, "abababab " * 30, "x" * 70, "a.b,c;d:e!f?g é.È, ×.÷, .com e.g. 1.5 x² ².", "word.\nNext,\n\nlast.\n"]


@pytest.mark.parametrize("bound", [200_000, 3])
def test_odd_texts(spark, libraries, bound):
    """Nulls, blanks, marks, repeated rows; with all pairs broadcast and with most of them shuffled."""
    ship(spark)
    rng = random.Random(4)
    made = ["".join(rng.choice([" ", "  ", "\n", "a", "the", "é", "'s", "7", ".", ",", "×", "com", "­", "ing", "日"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(ODD + made)] + [(None, "no id"), (3, "   "), (4, "a  b ")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B, bound=bound).collect()
    order = lambda r: (r[0] is None, r[0] or 0, tuple(r)[1:7])
    same(sorted(got, key=order), sorted(brute(rows, libraries), key=order))


def test_other_tables(spark, documents, nothing, libraries):
    assert alignment.align(nothing, A, B).collect() == []
    got = alignment.align(documents, A, B).collect()
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, tuple(r)[1:7])
    same(sorted(got, key=order), sorted(brute(rows, libraries), key=order))


def test_groups(spark, libraries):
    """Groups put together are the tokens, and no end within a group is common."""
    ship(spark)
    rows = [(i, t) for i, t in enumerate(ODD)]
    found = defaultdict(list)
    for r in alignment.group_rows(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect():
        found[r.doc_id].append(r)
    for key, text in rows:
        left, right = tokens(text, libraries)
        own = sorted(found[key], key=lambda r: r.group)
        assert [i for r in own for i in r.a_ids] == [i for i, _ in left] and [i for r in own for i in r.b_ids] == [i for i, _ in right]
        assert [(r.group, r.start) for r in own] == list(zip(range(len(own)), [0, *(r.end for r in own)]))
        common = {e for _, e in spans(left)} & {e for _, e in spans(right)}
        assert [r.end for r in own] == sorted(common)


def test_division_against_sets():
    rng = np.random.default_rng(5)
    for density in (0.02, 0.3, 0.9):
        for n in (1, 2, 40, 3000):
            a, b = (np.append(np.flatnonzero(rng.random(n) < density), n) for _ in range(2))
            at_a, at_b = alignment.shared_cuts(a, b, np.array([len(a) - 1]), np.array([len(b) - 1]))
            common = np.intersect1d(a, b)
            assert (a[at_a] == common).all() and (b[at_b] == common).all() and at_a.sum() == at_b.sum() == len(common)
    a, b = np.append(np.arange(2, 400_000, 2), 400_001), np.append(np.arange(3, 400_000, 2), 400_001)  # nothing in common but the end
    assert alignment.shared_cuts(a, b, np.array([len(a) - 1]), np.array([len(b) - 1]))[0].sum() == 1


def test_long_texts(libraries):
    """White space and words without a place to cut, of over a million characters."""
    import pyarrow as pa

    p = alignment.pair(A, B)
    for text in (" " * 1_000_000, "ab" * 500_000, "\n " * 300_000, "a " * 600_000):
        x = alignment.Aligned(pa.array([text]), p)
        left, right = tokens(text, libraries)
        assert x.ids[0].tolist() == [i for i, _ in left] and x.ids[1].tolist() == [i for i, _ in right]
        assert x.cut[0].sum() == len({e for _, e in spans(left)} & {e for _, e in spans(right)})
