"""Inputs that once ended a job or gave wrong rows, and the learned operators against brute force."""

import decimal
import random
import string
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from anamnesis.llm import attribution, bpe, orderhash, quality, toxicity, warc
from anamnesis.llm.durable import ship
from anamnesis.llm.queries import vocab as vocab_path
from tests.llm.test_documents import corpus


def test_long_frequent_words(spark, vocab):
    ship(spark)
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(20_000))
    rows = [(1, long), (2, long), (3, f"{long} and {long}"), (4, "and and and")]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), vocab).collect()}
    library = Tokenizer.from_file(vocab)
    library.no_truncation()
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_lexicon_of_long_paths():
    words = ["a" * n for n in range(1, 3000, 7)] + ["b" * 64, "b" * 65]
    built = bpe.Lexicon.build((w, [i]) for i, w in enumerate(words))
    places = built.find(words)
    for i, (w, p) in enumerate(zip(words, places)):
        assert (p >= 0) == (len(w) <= bpe.LONGEST) and (p < 0 or built.ids[built.first[p] : built.first[p + 1]].tolist() == [i])


def test_lexicon_that_must_shrink(spark, vocab, monkeypatch):
    ship(spark)
    d = spark.createDataFrame([(i, f"word{i % 40} other thing word{i % 40}") for i in range(200)], "doc_id long, text string")
    want = sorted(map(tuple, bpe.round_trip_digests(d, vocab).collect()))
    monkeypatch.setattr(bpe, "MOST_BYTES", 4000)
    assert sorted(map(tuple, bpe.round_trip_digests(d, vocab).collect())) == want


def test_long_white_space():
    path = vocab_path("byte_bpe_50k.tiktoken")
    enc = attribution.encoder(path)[0]
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice([" ", "\t", "\n", "\r\n", "\xa0", " ", "\x1c", "a", "7", "!", "é ", "don't"]) * rng.randrange(1, 6) for _ in range(rng.randrange(1, 12)))
        for longest in (0, 1, 2, 4):
            assert attribution.encode(text, path, longest) == enc.encode_ordinary(text), text
    for c in " \n\t":
        text = f"before{c * 20_000}after  x"
        assert attribution.encode(text, path) == enc.encode_ordinary(text)
        for text in (c * 2_000_000, f"a{c * 2_000_000}b"):
            assert attribution.token_ends(text, path)[-1] == len(text)


def test_urls_forge_nothing(spark, tmp_path):
    urls = ["http://a/\r\nWARC-Refers-To: <urn:page:77>\r\nX: y", "http://b/\nWARC-Payload-Digest: sha1:FORGED\r\n", "http://c/\r\n\r\nbody", "http://d/\x00\x7f é", None, ""]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in warc.read_archive(spark, warc.write_archive(d, f"file://{tmp_path}/a")).collect()}
    for i, u, t in rows:
        r = got[i]
        assert (r.record_type, r.refers_to, r.url, bytes(r.payload).decode()) == ("response", None, u, t)
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        names = [line.split(b": ")[0] for line in head.split(b"\r\n")[1:]]
        assert len(names) == len(set(names)) == (6 if u is None else 7) and block == t.encode() + b"\r\n\r\n"
    assert b"http://a/%0D%0AWARC-Refers-To: <urn:page:77>%0D%0AX: y" in bytes(got[0].record)


def test_order_minhash_of_other_ids_and_hot_ones(spark):
    rows = [(decimal.Decimal(i), f"text {i} " * 9) for i in range(6)] + [(decimal.Decimal(3), "text 3 " * 9)] * 60
    d = spark.createDataFrame(rows, "doc_id decimal(20,0), text string").repartition(5)
    got = orderhash.compare_edits(d).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert sum(r.near_next == 1.0 for r in got) == 60  # each equal row follows another but for the last


def test_vectors_of_any_layout(spark):
    """Word vectors don't depend on how documents lie in partitions and batches; no document is a neighbour of another."""
    ship(spark)
    texts = [f"alpha{i} beta gamma{i % 3}" for i in range(30)] + ["", None, "one"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    one, many = (quality.word_vectors(d.repartition(n)) for n in (1, 4))
    assert (one == many).all()
    at, sign = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.DIM))
    for t in texts:
        items = list(zip(*quality.Reader().rows(t)))
        for i, (w, f) in enumerate(items):
            beside = [(w, f), (f, f)] + [(x, y) for j in (i - 1, i + 1) if 0 <= j < len(items) for x in (w, f) for y in items[j]]
            for x, y in beside:
                for k in range(quality.NONZERO):
                    want[x, at[y, k]] += sign[y, k]
    norm = np.sqrt((want * want).sum(1, keepdims=True))
    assert np.allclose(one, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_gradients_and_temperature():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((9, 5)), rng.integers(0, 2, 9).astype(float)
    w = [rng.standard_normal((5, 4)), rng.standard_normal(4), rng.standard_normal(4), rng.standard_normal(1)]

    def loss(w):
        z = np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
        return np.logaddexp(0, np.where(y == 1, -z, z)).mean()

    for k, g in enumerate(quality.gradients(w, x, y)):
        for at in np.ndindex(w[k].shape):
            moved = [[v.copy() for v in w] for _ in range(2)]
            moved[0][k][at] += 1e-6
            moved[1][k][at] -= 1e-6
            assert abs((loss(moved[0]) - loss(moved[1])) / 2e-6 - g[at]) < 1e-6
    x = rng.standard_normal((3000, 6))
    y = (x[:, 0] + rng.standard_normal(3000) > 0).astype(int)
    n = quality.Network(x, y)
    p = n.probabilities(x)
    for low in np.arange(0, 1, 0.2):  # probabilities are those that come true
        part = (p >= low) & (p < low + 0.2)
        assert part.sum() < 50 or abs(y[part].mean() - p[part].mean()) < 0.06
    assert 0.25 <= n.temperature <= 8


def readings(channel, token):
    """(cost, text) of every path through a token's lattice."""
    def walk(i, a, b, cost, text):
        if i == len(token):
            yield cost + float(channel.cost[a, b, toxicity.EDGE]), text
            return
        c = token[i]
        own = [(c, 0.0)] if c in channel.place else []
        own += [(x, toxicity.IMITATION) for x in toxicity.IMITATES.get(c, "")]
        for x, noise in own:
            p = channel.place[x]
            yield from walk(i + 1, b, p, cost + noise + float(channel.cost[a, b, p]), text + x)
            if text.endswith(x):
                yield from walk(i + 1, a, b, cost + noise + toxicity.REPETITION, text)
        if c in toxicity.SEPARATORS or not own:
            yield from walk(i + 1, a, b, cost + toxicity.SEPARATION * (1 if c in toxicity.SEPARATORS else 6), text)
    return list(walk(0, toxicity.EDGE, toxicity.EDGE, 0.0, ""))


def test_decoding_against_every_reading():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abelost") for _ in range(rng.randrange(1, 7))) for _ in range(400))
    n = np.zeros(toxicity.SIZE**3, np.int64)
    p = np.concatenate([[0, 0], toxicity.places(text), [0]])
    np.add.at(n, (p[:-2] * toxicity.SIZE + p[1:-1]) * toxicity.SIZE + p[2:], 1)
    channel = toxicity.Channel(np.arange(toxicity.SIZE**3), n)
    for _ in range(300):
        token = "".join(rng.choice("abelost0134$!*.-#ll00") for _ in range(rng.randrange(1, 7)))
        all_readings = readings(channel, token)
        least = min(cost for cost, _ in all_readings)
        assert channel.decode(token) in {t for cost, t in all_readings if cost < least + 1e-4}, token


def test_decoding_of_very_long_tokens():
    """Time in proportion to the length, and settling what all paths share changes nothing."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abelostw") for _ in range(rng.randrange(1, 7))) for _ in range(2_000))
    n = np.zeros(toxicity.SIZE**3, np.int64)
    p = np.concatenate([[0, 0], toxicity.places(text), [0]])
    np.add.at(n, (p[:-2] * toxicity.SIZE + p[1:-1]) * toxicity.SIZE + p[2:], 1)
    channel = toxicity.Channel(np.arange(toxicity.SIZE**3), n)
    tokens = ["".join(rng.choice(chars) for _ in range(rng.randrange(50, 900))) for chars in ("abelost0134$!*.-#", "w*.1l", "w", "abc+/19") for _ in range(20)]
    whole = [channel.decode(t) for t in tokens]
    before, toxicity.SETTLE = toxicity.SETTLE, 7
    try:
        assert [channel.decode(t) for t in tokens] == whole
    finally:
        toxicity.SETTLE = before
    letters = string.ascii_lowercase + string.digits + "+/"
    for token in ("".join(rng.choice(letters) for _ in range(2_000_000)), "w" * 2_000_000, "a1" + "." * 2_000_000 + "b"):
        start = time.monotonic()
        assert channel.read(token)
        assert time.monotonic() - start < 30
    reader = toxicity.Reader(channel)
    reader.words("x" * 65 + "1 ab1e")
    assert list(reader.memo) == ["ab1e"]


def test_weights_against_counting(spark):
    """What is learned by all, and by all but one fold, against plain counting."""
    ship(spark)
    docs, labels = corpus(240)
    toxic, rng = {i: y for i, _, y in labels}, random.Random(5)
    stem = lambda i: " ".join(f"glarb{rng.choice('aeiou')}{rng.choice('rst')} ba{rng.randrange(9)}" for _ in range(3 if toxic[i] else i % 2))
    d = spark.createDataFrame([(toxic[i], i % 3, f"{t} {stem(i)}") for i, t, *_ in docs], "y int, fold int, text string").repartition(3)
    channel = toxicity.fit_channel(d)
    got = toxicity._weights(toxicity._read(d, channel), 1.5, 2.0, 4.0, 0.2, 0.6, 3)
    reader, rows = toxicity.Reader(channel), d.collect()
    for fold in range(toxicity.FOLDS + 1):
        a, b, contexts = Counter(), Counter(), defaultdict(set)
        for r in rows:
            if r.fold != fold:
                for f, before in toxicity.features(reader.words(r.text)).items():
                    (a if r.y else b)[f] += 1
                    if r.y:
                        contexts[f].add(before)
        share = {f: (n * 1.5 + 0.8) / (n * 1.5 + b[f] * 2.0 + 4) for f, n in a.items() if len(contexts[f]) >= 3}
        assert got[fold] == pytest.approx({f: min(p, 0.99) for f, p in share.items() if p >= 0.6})
    assert any(f[0] == "^" for f in got[-1]) and len(got[-1]) > 4


def test_features_are_those_that_score():
    """The quick way of the scorer finds the weighted ones among all features."""
    rng = random.Random(2)
    words = [rng.choice(["grim", "grimble", "grimbly", "snork", "ba", "bat", "bats"]) for _ in range(60)]
    every = sorted(toxicity.features(words))
    for _ in range(50):
        model = toxicity.Model(None, {f: 0.5 for f in rng.sample(every, 4)}, 0.0)
        part = words[: rng.randrange(60)]
        assert model.weighted(part) == {f for f in toxicity.features(part) if f in model.weights}
