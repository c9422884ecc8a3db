import hashlib
import random
import time
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from anamnesis.llm import attribution, bpe, packing, wordpiece
from tests.llm.conftest import ROWS

ODD = ["", "ΑΣ Σ ΟΔΟΣ", "a\x1cb \x1f", "½ ² Ⅷ x²y", "it's I'LL <|endoftext|>Foo<|startoftext|>", "J̌ ǰ İ", "日本語 123 !!!\x85 x", "_a_b'd'", "a​b", "aaaa aaaaa !!!!!!!", "é b", "x" * 3000]


def library(vocab):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab)


def test_encoding_equals_the_library(vocab):
    lib, v = library(vocab), wordpiece.vocabulary(vocab)
    rng = random.Random(3)
    texts = ODD + [" ".join("".join(rng.choice("aeioußnrst'’.,!éÈ1²_ ") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    words = ["the", "then", "ring", "kings", "a", "é"]
    flat, n = v.merge(words)
    lexicon = bpe.Lexicon.build((w, x.tolist()) for w, x in zip(words, np.split(flat, np.cumsum(n)[:-1])))
    for resolve in (v.merge, bpe.resolver(lexicon, v)):
        table = wordpiece.ChunkTable(resolve, limit=50)
        for a in range(0, len(texts), 7):
            ids, n = table.encode(texts[a : a + 7])
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts[a : a + 7]]


def test_lexicon_is_minimal_and_survives_a_file(tmp_path):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    built = bpe.Lexicon.build((w, [i, i + 1]) for i, w in enumerate(words))
    (tmp_path / "x").write_bytes(built.dump())
    lexicon = bpe.Lexicon.load(str(tmp_path / "x"))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert (lexicon.find(["", "d", "abcabcabc", "cccccca"]) == -1).all()
    # states of a minimal automaton are the distinct sets of suffixes
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in [w[:i] for i in range(len(w) + 1)]}
    assert len(lexicon.final) == len(suffixes)
    assert (bpe.Lexicon.build([]).find(["a", ""]) == -1).all()


def test_round_trip_of_odd_rows(spark, documents, nothing, vocab):
    lib = library(vocab)
    rows = bpe.round_trip_digests(documents, vocab, entries=4).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.round_trip_digests(nothing, vocab).count() == 0
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(documents, vocab), vocab).collect()}
    assert decoded[1].startswith("the</w> quick</w>") and decoded[2] == ""


@pytest.mark.parametrize("quantum", [1, 7, 64, 200])
@pytest.mark.parametrize("weights", [None, [3.0, 1.0, 1e-6, 5.0, 1.0, 1.0]])
def test_schedule_against_a_loop(weights, quantum):
    totals = [700, 1300, 5, 90, 0, 90]
    s = packing.Schedule(totals, weights, 64, quantum)
    exact = [Fraction(int(w)) for w in s.weights]
    shares = totals if weights is None else weights
    assert all(abs(float(w) / max(map(float, exact)) - x / max(shares)) < 1e-9 for w, x in zip(exact, shares) if x)
    due = sorted(((2 * (i // quantum) + 1) / exact[q], q, i) for q in range(6) for i in range(totals[q]))
    place = {(q, i): k for k, (_, q, i) in enumerate(due)}
    queue, start, length = [], [], []
    for q in range(6):  # stretches of many lengths
        at = 0
        while at < totals[q]:
            n = min(totals[q] - at, 1 + (at * 7 + q) % 150)
            queue, start, length, at = [*queue, q], [*start, at], [*length, n], at + n
    seen = []
    ends = s.ends(np.arange(s.sequences + 1)).tolist()
    for r, x, k, w, o in zip(*map(np.ndarray.tolist, s.cut(*map(np.array, (queue, start, length))))):
        want = [place[queue[r], start[r] + x + i] for i in range(k)]
        assert want == list(range(ends[w] + o, ends[w] + o + k)) and want[-1] < ends[w + 1]
        seen += want
    assert sorted(seen) == list(range(sum(totals)))


def test_schedule_of_huge_and_of_many_queues():
    """No overflow at 10 ** 14 ids, and thousands of queues in time."""
    s = packing.Schedule([10**14, 3 * 10**13, 1, 64], None, 2048, 64)
    r, x, k, w, o = s.cut(np.array([0, 1, 2, 3]), np.array([10**14 - 300, 5, 0, 0]), np.array([300, 900, 1, 64]))
    assert np.bincount(r, k).tolist() == [300, 900, 1, 64] and (w >= 0).all() and (w < s.sequences).all() and (o + k <= 2048).all()
    totals = [400 + i % 50 for i in range(5_000)]
    s = packing.Schedule(totals, None, 2048, 64)
    began = time.monotonic()
    r, x, k, w, o = s.cut(np.arange(5_000), np.zeros(5_000, np.int64), np.array(totals))
    assert time.monotonic() - began < 20 and len(r) < 10 * 5_000
    at = np.sort(s.ends(w) + o)
    assert at[0] == 0 and len(np.unique(at)) == len(at) and k.sum() == sum(totals)
    order = np.argsort(s.ends(w) + o)
    assert ((s.ends(w) + o + k)[order][:-1] == at[1:]).all()


def check_pieces(rows, texts, vocab, window):
    lib = library(vocab)
    taken, per_doc = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == taken[r.sequence_id]
        taken[r.sequence_id] += r.length
        per_doc[r.doc_id].append(r)
    assert all(n <= window for n in taken.values()) and sum(n < window for n in taken.values()) <= window.bit_length()
    assert all(n == window or n & (n - 1) == 0 for n in taken.values())
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(per_doc[i], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_of_odd_rows(documents, nothing, vocab):
    texts = {i: t for i, t, *_ in ROWS if i != 5}
    pieces = packing.pack(documents.where("doc_id <> 5 OR doc_id IS NULL"), vocab, window=256)
    check_pieces(pieces.collect(), texts, vocab, 256)
    seq = packing.sequences(pieces, 256).collect()
    assert sum(r.length for r in seq) == sum(len(r.ids) // 2 for r in seq) and all(r.padded_length in (r.length, 256) for r in seq)
    assert packing.pack(nothing, vocab).count() == 0
    twice = packing.pack(documents.where("doc_id = 5"), vocab).agg({"length": "sum"}).first()[0]
    assert twice == 2 * (len(library(vocab).encode(ROWS[4][1], add_special_tokens=False).ids) + 1)


def test_packing_holds_the_mixture(spark, vocab):
    rows = [(i, f"word{i} " * 40, "a" if i % 3 else "b") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(d, vocab, window=128)
    check_pieces(got.collect(), {i: t for i, t, _ in rows}, vocab, 128)
    per = got.groupBy("sequence_id", "queue").sum("length").collect()
    share = defaultdict(int)
    for r in per:
        share[r.queue] += r[2]
    for r in per:
        if r.sequence_id < sum(share.values()) // 128:
            assert abs(r[2] - 128 * share[r.queue] / sum(share.values())) <= 1.01
    weighted = packing.pack(d, vocab, window=128, weights={"a": 1.0, "b": 1.0}).groupBy("sequence_id", "queue").sum("length").where("sequence_id < 10").collect()
    assert all(abs(r[2] - 64) <= 1 for r in weighted)
    with pytest.raises(ValueError):
        packing.pack(d, vocab, weights={"a": 1.0, "b": 0.0})
    larger = packing.pack(d, vocab, window=128, quantum=16)
    check_pieces(larger.collect(), {i: t for i, t, _ in rows}, vocab, 128)
    assert larger.count() < got.count() / 3
    given = defaultdict(int)  # of the first windows together the shares hold as well as of one
    for r in larger.groupBy("sequence_id", "queue").sum("length").collect():
        for last in range(r.sequence_id, sum(share.values()) // 128):
            given[last, r.queue] += r[2]
    assert all(abs(n - 128 * (last + 1) * share[q] / sum(share.values())) <= 16.01 for (last, q), n in given.items())


def brute_sections(text, ends, starts, size, rule):
    begins = [0, *ends[:-1]]
    out = [0.0] * len(starts)
    for b, e in zip(begins, ends):
        for s, lo in enumerate(starts):
            hi = starts[s + 1] if s + 1 < len(starts) else size
            if rule == "start":
                out[s] += lo <= b < hi
            elif rule == "end":
                out[s] += lo < e <= hi
            else:
                out[s] += max(0, min(e, hi) - max(b, lo)) / (e - b)
    return out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_against_brute_force(rule):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for text in ("one\n\n\n\n\ntwo lines\nthree", "é\nü🙂\n", "x", "  \n  \n", "a\n" * 50):
        raw = text.encode()
        ends = attribution.token_ends(text, path)
        assert ends[-1] == len(raw)
        starts = attribution.line_starts(raw)
        counts, crossing = attribution.attribute(ends, starts, len(raw), rule)
        assert np.allclose(counts, brute_sections(text, ends.tolist(), starts.tolist(), len(raw), rule)) and np.isclose(counts.sum(), len(ends))


def test_attribution_of_odd_rows(documents, nothing):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = attribution.section_tokens(documents, path).collect()
    for i, t, *_ in ROWS:
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.n_tokens for r in mine) == sum(r.doc_tokens for r in mine if r.section == 0)
        assert max(r.char_end for r in mine) == len(t or "") and min(r.char_start for r in mine) == 0
    assert attribution.section_tokens(nothing, path).count() == 0
    halves = attribution.section_tokens(documents.where("doc_id = 1"), path, pattern="It's").collect()
    assert [r.section for r in halves] == [0, 1]
    with pytest.raises(ValueError):
        attribution.section_tokens(documents, path, rule="majority")
