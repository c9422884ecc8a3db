"""Every registered query over a whole small table, against what its contract says."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from anamnesis.llm import attribution, orderhash, sharding
from anamnesis.llm.queries import ORACLES, QUERIES
from tests.llm.test_duplicates import brute_fingerprint, components
from tests.llm.test_tokens import check_pieces

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r.doc_id: r.text for r in pd.read_parquet(f"{DIR}/documents.parquet").itertuples()}


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: QUERIES[name](spark, DIR)


def test_packing(run, docs, vocab):
    found = run("op1_packing")
    assert found.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(found.collect(), docs, vocab, 2048)


def test_warc(run):
    found = run("op2_warc")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
        want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLES['op2_warc']})").fetchall()
    assert sorted(map(tuple, found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == sorted(want, key=str)


def test_token_counts(run, docs):
    from anamnesis.llm.queries import vocab as path

    enc = attribution.encoder(path("byte_bpe_50k.tiktoken"))[0]
    rows = defaultdict(list)
    for r in run("op3_token_counts").collect():
        rows[r.doc_id].append(r)
    assert set(rows) == set(docs)
    for i, text in docs.items():
        text, n = text or "", len(enc.encode_ordinary(text or ""))
        parts = sorted(rows[i], key=lambda r: r.section)
        assert sum(r.n_tokens for r in parts) == n == parts[0].doc_tokens
        assert "".join(text[r.char_start : r.char_end] for r in parts) == text


def test_bpe(run, docs, vocab):
    library = Tokenizer.from_file(vocab)
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in run("op4_bpe").collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize(("name", "label", "modulus", "held", "least"), [("op5_toxicity", "toxic", 4, 2, 0.3), ("op7_quality", "quality", 3, 1, 0.5)])
def test_scores(run, docs, name, label, modulus, held, least):
    got = {r.doc_id: r for r in run(name).collect()}
    assert set(got) == set(docs) and len(got) == len(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == held) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1
    labels = {r.doc_id: getattr(r, label) for r in pd.read_parquet(f"{DIR}/labels.parquet").itertuples()}
    right = [got[i].predicted == y for i, y in labels.items() if i in got and got[i].held_out]
    assert len(right) > 10 and np.mean(right) > 0.8


def test_shards(run, docs):
    rows = run("op6_kd_shards").collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    slots = defaultdict(list)
    weight = Counter()
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
        weight[r.shard] += r.size
    assert all(sorted(s) == [*range(len(s))] for s in slots.values()) and len(slots) == 24


def test_cuts_are_weighted_medians(spark):
    """Each cell is cut along its widest dimension, where a sorted list of its points has the goal."""
    rng = np.random.default_rng(3)
    rows = [(int(k), int(w), False, int(a), int(b), int(c)) for k, w, a, b, c in zip(rng.integers(-(2**62), 2**62, 700), rng.integers(1, 50, 700), rng.integers(0, 2**23, 700), rng.integers(0, 5, 700) * 10**6, rng.integers(0, 2**10, 700))]
    points = spark.createDataFrame(rows, "key long, weight long, heavy boolean, by_size long, by_source long, by_lang long")
    placed = sharding.build_tree(points, 7).select("cell", "weight", *sharding.DIMENSIONS, *(sharding._order(d).alias(f"at_{d}") for d in sharding.DIMENSIONS)).collect()
    assert len(placed) == 700

    def check(cell, shards, inside):
        if shards == 1:
            assert {r.cell for r in inside} == {cell}
            return
        under = lambda r, c: r.cell >> (r.cell.bit_length() - c.bit_length()) == c
        left, right = [r for r in inside if under(r, 2 * cell)], [r for r in inside if under(r, 2 * cell + 1)]
        assert len(left) + len(right) == len(inside)
        spread = {d: max(r[d] for r in inside) - min(r[d] for r in inside) for d in sharding.DIMENSIONS}
        widest = f"at_{max(spread, key=spread.get)}"
        assert max(r[widest] for r in left) < min(r[widest] for r in right)
        total, goal = sum(r.weight for r in inside), sum(r.weight for r in inside) * (shards // 2) / shards
        below = [abs(goal - x) for x in np.concatenate([[0], np.cumsum([r.weight for r in sorted(inside, key=lambda r: r[widest])])])]
        assert abs(goal - sum(r.weight for r in left)) <= min(below) + total / shards / 4096
        check(2 * cell, shards // 2, left)
        check(2 * cell + 1, shards - shards // 2, right)

    check(1, 7, placed)


def test_embeddings(run):
    rows = [(r.vec_id, r.embedding, r.label) for r in pd.read_parquet(f"{DIR}/embeddings.parquet").itertuples()]
    unit = np.array([np.asarray(v, np.float32).astype(float) for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([c for *_, c in rows])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    want = components(len(rows), [(i, j) for i, j in zip(*np.nonzero(linked)) if i < j])
    got = {r.vec_id: r for r in run("op8_embedding_dedup").collect()}
    assert len(got) == len(rows)
    for k, (i, *_) in enumerate(rows):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[k].sum(), rows[want[k]][0], i == rows[want[k]][0])


def test_simhash(run, docs):
    ids = sorted(docs)
    prints = np.array([brute_fingerprint(docs[i]) for i in ids], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    want = components(len(ids), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run("op9_simhash").collect()}
    assert got == {i: (f"{int(p):016x}", ids[c]) for i, p, c in zip(ids, prints, want)}


def test_order_minhash(run, docs):
    got = {r.doc_id: r for r in run("op10_order_minhash").collect()}
    order = sorted(docs, reverse=True)
    assert set(got) == set(docs)
    for i, j in zip(order, [*order[1:], order[0]]):
        own, following = docs[i] or "", docs[j] or ""
        other = orderhash.edited(own, following)
        a, b, c = map(orderhash.signature, (own, other, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(own), hashlib.sha256(other.encode()).hexdigest(), orderhash.written(a), orderhash.written(b))
        assert (r.near_edited, r.near_next) == (orderhash.likeness(a, b), orderhash.likeness(a, c))
