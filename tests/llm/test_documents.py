import base64
import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from anamnesis.llm import orderhash, quality, sharding, toxicity, warc
from anamnesis.llm.queries import ORACLES, remainder
from tests.llm.conftest import EXTRA, ROWS


def test_archive(spark, tmp_path):
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate(["<p>é</p>", "same", "same", None, "", "same", "last\r\nWARC-Type: x\r\n"])] + [(9, None, "same"), (10, "u", "only")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS address", "'z' AS payload", "'z' AS owner", "'z' AS id").repartition(3)
    path = warc.write_archive(d, f"file://{tmp_path}/a")
    got = {r.id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows)
    for i, url, t in rows:
        raw = (t or "").encode()
        owner = max(j for j, _, u in rows if (u or "") == (t or ""))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, bytes(r.payload), r.url) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), raw, url)
        assert (r.record_type, r.refers_to) == (("response", None) if owner == i else ("revisit", owner))
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest == (raw if owner == i else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(raw) if owner == i else 0}".encode() in head
    assert spark.read.parquet(f"{path}/payloads").count() == len({t or "" for _, _, t in rows})
    small = warc.read_archive(spark, warc.write_archive(d, f"file://{tmp_path}/b", least_bytes=5)).where("record_type = 'revisit'").count()
    assert small == 0
    assert warc.read_archive(spark, warc.write_archive(d.limit(0), f"file://{tmp_path}/c")).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {'NULL' if u is None else repr(u)}, {'NULL' if t is None else chr(39) + t + chr(39)})" for i, u, t in rows) + ") t(page_id, url, html)")
    assert sorted(con.execute(f"SELECT page_id, payload_digest, record_type FROM ({ORACLES['op2_warc']})").fetchall()) == sorted((r.id, r.payload_digest, r.record_type) for r in got.values())


def test_archive_with_a_hot_page(spark, tmp_path):
    """A page that is a third of all, and rows that repeat an id: the records of one address are put together in many tasks."""
    rows = [(i, f"http://x/{i}", "hot page" if i % 3 == 0 else f"page {i // 2}") for i in range(3_000)] + [(3, "http://x/3", "hot page")] * 500
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = warc.write_archive(d, f"file://{tmp_path}/a")
    plain = sorted(tuple(r) for r in warc.read_archive(spark, path, hot_records=10**9).collect())
    own = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for key, value in zip(own, ("false", "16")):
        spark.conf.set(key, value)
    try:
        split = warc.read_archive(spark, path, hot_records=50)
        tasks = [r["count"] for r in split.where("url IS NOT NULL AND CAST(payload AS STRING) = 'hot page'").groupBy(F.spark_partition_id()).count().collect()]
        assert sorted(tuple(r) for r in split.collect()) == plain and len(plain) == len(rows)
        assert sum(tasks) == 1_500 and len(tasks) > 8 and max(tasks) < 500
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)


def test_order_minhash(spark, documents, nothing):
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    one = documents.where("doc_id <> 5 OR doc_id IS NULL")
    got = {r.doc_id: r for r in orderhash.compare_edits(one).collect()}
    rows = [(i, t or "") for i, t, *_ in rows if i != 5]
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        own, its = orderhash.signature(t), orderhash.signature(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (orderhash.written(own), orderhash.written(orderhash.signature(edited)))
        assert (r.near_next, r.near_edited) == (orderhash.likeness(own, its), orderhash.likeness(own, orderhash.signature(edited)))
    assert orderhash.compare_edits(nothing).count() == 0
    assert orderhash.compare_edits(documents.where("doc_id = 5")).count() == 2
    alone = orderhash.compare_edits(documents.where("doc_id = 1")).first()
    assert alone.near_next == 1.0
    fingerprints = {r.doc_id: r.fingerprint for r in orderhash.fingerprints(one).collect()}
    assert all(got[i].fingerprint == f for i, f in fingerprints.items())


def brute_signature(text):
    h = orderhash.kmers(text)
    seen, u = defaultdict(int), []
    for x in h.tolist():
        k = seen[x]
        seen[x] += 1
        u.append((x, k))
    u = np.array([int(orderhash.mix(np.array([(x + k * int(orderhash.BASE)) % (1 << 64)], np.uint64))[0]) for x, k in u], np.uint64)
    out = []
    for s, f in enumerate(orderhash.FACTORS):
        best = sorted(range(len(u)), key=lambda i: (int(f * u[i]), i))[: orderhash.DEPTH]
        v = np.array([s + 1], np.uint64)
        for i in sorted(best):
            v = orderhash.mix(v * orderhash.BASE + h[i : i + 1])
        out.append(int(v[0]) >> 48)
    return out


def test_signature_against_brute_force(monkeypatch):
    monkeypatch.setattr(orderhash, "BLOCK", 16)
    for text in ("", "short", "abcabcabcabcabcabcabcabc", "the quick brown fox jumps over the lazy dog and runs", "aaaaaaaaaaaaaaaaaaaaaaaaaaa"):
        with np.errstate(over="ignore"):
            assert orderhash.signature(text).tolist() == brute_signature(text)


def test_edits_lower_likeness():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    text, other = " ".join(words), " ".join(reversed(words))
    near = [orderhash.likeness(orderhash.signature(text), orderhash.signature(orderhash.edited(text[: -n or None], other))) for n in (0, 800)]
    assert 0.1 < near[0] < 0.9 and orderhash.likeness(orderhash.signature(text), orderhash.signature(other)) < 0.2


def test_shards(spark, documents, nothing):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(1, 60) + str(i % 900), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c"])) for i in range(1200)] + [(2000 + i, "copied text " * 4, "en", "a") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = sharding.shard(d, 8).collect()
    texts = {r[0]: r[1] for r in rows}
    sizes, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id]].add(r.shard)
    mean = sum(sizes.values()) / 8
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    assert all(len(h) == 1 for h in homes.values())
    by_target = sharding.shard(d, None, target_bytes=int(mean) + 1).select("shard").distinct().count()
    assert by_target == 8
    hot = spark.createDataFrame([(i, "one text", "en", "a") for i in range(400)] + [(1000 + i, f"text {i}", "de", "b") for i in range(800)], "doc_id long, text string, lang string, source string")
    weights = [r[1] for r in sharding.shard(hot, 8).groupBy("shard").sum("size").collect()]
    assert len(weights) == 8 and max(weights) < 1.25 * sum(weights) / 8
    odd = sharding.shard(documents, 3).collect()
    assert len(odd) == len(ROWS) and {r.size for r in odd if r.doc_id in (2, 3)} == {8}
    assert sharding.shard(nothing, 3).count() == 0 and set(EXTRA) - set(documents.columns) == set()


def corpus(n):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "ti", "no", "ren", "sol", "ka"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(40)]
        toxic, poor = i % 5 == 0, i % 4 == 1
        if toxic:
            for bad in rng.sample(["grimble", "snorkle", "vilegit", "mudface"], 2):
                words.insert(rng.randrange(40), bad)
        if poor:
            words = [w.upper() + "!!" for w in words] if i % 8 == 1 else [w + "###" for w in words]
        docs.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def test_classifiers(spark, documents, nothing):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    model = toxicity.fit(d, lab, lambda i: remainder(4)(i) != 2)
    scores = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert len(scores) == 600 and np.mean([(scores[i] >= 0.3) == bool(t) for i, _, t in labels if i in held]) > 0.97
    hidden = spark.createDataFrame([(1, "ba ti gr1mble no"), (2, "ba g r i m b l e no"), (3, "ba grrrrimble no"), (4, "ba ti no"), (5, None), (6, "")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(hidden, model).collect()}
    assert min(found[i] for i in (1, 2, 3)) >= 0.3 > max(found[i] for i in (4, 5, 6))
    restored = {r.doc_id: r.text for r in toxicity.restore(hidden, model.channel).collect()}
    assert restored[1] == "ba ti grimble no" and restored[2].endswith("grimble no") and restored[5] == ""
    fitted = quality.fit(d, lab, lambda i: remainder(3)(i) != 1)
    scores = {r.doc_id: r.score for r in quality.score(d, fitted).collect()}
    apart = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.5) == bool(labels[i][1]) for i in apart]) > 0.97
    for module, m in ((toxicity, model), (quality, fitted)):
        odd = module.score(documents, m).collect()
        assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
        assert module.score(nothing, m).count() == 0
        none = module.fit(nothing, lab, lambda i: remainder(3)(i) != 1)
        assert module.score(documents, none).count() == len(ROWS)
    assert {r.score for r in quality.score(documents, quality.fit(d, lab.limit(0), lambda i: i > 0)).collect()} == {0.5}


def test_calibration_steps():
    """Against the least-squares rising fit by brute force over all ways to pool."""
    bins = [(0.6, 1, 8), (0.7, 3, 5), (0.8, 1, 6), (0.9, 40, 1), (0.99, 60, 0)]
    edges, levels = toxicity._calibration(bins, 1.0, 1.0, 0.0, 0.1)
    best = None
    for cuts in range(1 << (len(bins) - 1)):
        pools, start = [], 0
        for i in range(len(bins)):
            if i == len(bins) - 1 or cuts >> i & 1:
                part = bins[start : i + 1]
                a, n = sum(x[1] for x in part), sum(x[1] + x[2] for x in part)
                pools += [a / n] * len(part)
                start = i + 1
        if pools == sorted(pools):
            loss = sum(a * (1 - p) ** 2 + b * p * p for (_, a, b), p in zip(bins, pools))
            best = min(best or (loss, pools), (loss, pools))
    assert np.allclose([levels[np.searchsorted(edges, x[0], "right") - 1] for x in bins], best[1])
    assert [len(x) for x in toxicity._calibration([], 1.0, 1.0, 4.0, 0.1)] == [0, 0]
    m = toxicity.Model(None, {"odd": 0.7, "bad": 0.95}, 0.02)
    m.edges, m.levels = np.array([0.7, 0.9]), np.array([0.2, 0.97])
    assert m.score(["odd"]) < 0.3 < m.score(["odd", "bad"]) and m.score(["fine"]) == m.score([]) == 0.02


def test_channel_leaves_plain_words():
    text = "hello there good people say hello again and again " * 20
    n = np.zeros(toxicity.SIZE**3, np.int64)
    p = np.concatenate([[0, 0], toxicity.places(text), [0]])
    np.add.at(n, (p[:-2] * toxicity.SIZE + p[1:-1]) * toxicity.SIZE + p[2:], 1)
    c = toxicity.Channel(np.arange(toxicity.SIZE**3), n)
    assert [c.read(w) for w in ("hello", "(hello),", "h3llo", "helllllo", "g00d", "2024-05-01", "...", "12")] == ["hello", "hello", "hello", "hello", "good", "2024-05-01", "", "12"]
    assert c.restore("H e l l o good people") == "hello good people"
