"""Streams with state against plain loops, over several runs from the same checkpoint."""

import json
import random
from collections import OrderedDict


from anamnesis.schema import SAVE_EVENTS
from anamnesis.streaming import state
from anamnesis.streaming.saving import Saver


def run(spark, tmp_path, name, rows, schema, lots, make):
    """Rows in lots, each lot a run of its own; what was written."""
    for lot in range(lots):
        spark.createDataFrame([r for i, r in rows if i == lot], schema).coalesce(2).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
        make(events).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}/progress").trigger(availableNow=True).start(f"{tmp_path}/{name}/out").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{name}/out").collect()


def test_replies(spark, tmp_path):
    """Chunks cut anywhere, some early, some twice, some after the end."""
    rng, rows, want = random.Random(4), [], {}
    for i in range(12):
        words = [rng.choice(["é", "a\n", '"q" ', "🙂", "long word "]) for _ in range(20)]
        lines = [json.dumps({"choices": [{"delta": {"content": w}}]} if i % 2 else {"delta": {"type": "text_delta", "text": w}}, ensure_ascii=bool(i % 3)) for w in words]
        body = "".join(f"data: {x}\r\n\n" for x in lines) + ": note\ndata: {broken\ndata: 7\n" + ("data: [DONE]" if i % 4 else "data: [DONE]\n\ndata: {\"choices\": [{\"delta\": {\"content\": \"late\"}}]}\n")
        at, chunks = 0, []
        while at < len(body):
            step = rng.randrange(1, 40)
            chunks.append(body[at : at + step])
            at += step
        want[i] = "".join(words)
        for seq, c in enumerate(chunks):
            rows.append((min(2, rng.randrange(2) + seq * 3 // len(chunks)), (i, seq, c)))
            if rng.random() < 0.1:
                rows.append((2, (i, seq, c)))
    got = run(spark, tmp_path, "replies", rows, "stream_id long, seq long, chunk string", 3, state.replies)
    text, ended = {}, {}
    for r in sorted(got, key=lambda r: (r.stream_id, r.seq)):
        text[r.stream_id] = text.get(r.stream_id, "") + r.text
        ended[r.stream_id] = r.done
    assert text == want and all(ended.values()) and len(got) > len(want)


def test_recent_blocks(spark, tmp_path):
    rng = random.Random(7)
    log = [(c, i, f"k{int(rng.paretovariate(0.5)) % 60}", f"block {i}") for i in range(900) for c in (rng.choice("ab"),)]
    rows = [(i * 3 // 900, r) for i, r in enumerate(log)]
    got = {r.request_id: (r.hit, r.block) for lot in [run(spark, tmp_path, "blocks", rows, "cache string, request_id long, key string, block string", 3, lambda s: state.recent_blocks(s, 20))] for r in lot}
    held = {"a": OrderedDict(), "b": OrderedDict()}
    for cache, i, key, block in log:
        own = held[cache]
        hit = key in own
        if hit:
            own.move_to_end(key)
        else:
            own[key] = block
            if len(own) > 20:
                own.popitem(last=False)
        assert got[i] == (hit, own[key])
    assert 200 < sum(h for h, _ in got.values()) < 800


def test_expiry_between_batches(spark, tmp_path):
    """What has expired absorbs no duplicates: a like exchange goes in when it comes late, and touches when it comes in time."""
    day, v = 86400.0, [1.0, 0.0]
    event = lambda i, at, v: (i, "a", at * day, f"text {i}", "reply", v, v)
    lots = [
        [event(1, 100, v), event(2, 101, [0.0, 1.0])],
        [event(3, 103, v), event(4, 106, [0.6, -0.8])],  # 3 touches 1, in time; then the clock stands at 106
        [event(5, 107, v), event(6, 107, [0.6, -0.8]), event(7, 99, [-1.0, 0.0])],  # 1 has expired, 4 hasn't, 7 comes after its time
        [event(8, 107, [-1.0, 0.0])],
    ]
    saver = Saver(f"{tmp_path}/store", 0.9, ttl_days=5)
    assert saver.live(spark).count() == saver.facts(spark).count() == saver.sentences(spark).count() == 0
    for lot in lots:
        spark.createDataFrame(lot, SAVE_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        saver.start(spark, f"{tmp_path}/in", f"{tmp_path}/progress").awaitTermination()
        saver.expire(spark, f"{tmp_path}/timers").awaitTermination()
    assert {r.id for r in saver.read(spark, "memories").collect()} == {1, 2, 4, 5, 7, 8}
    assert {(r.id, r.by) for r in saver.read(spark, "touches").collect()} == {(1, 3), (4, 6)}
    assert {r.id for r in saver.live(spark).collect()} == {4, 5, 8}


def test_timers(spark, tmp_path):
    rng = random.Random(2)
    rows = [(lot, (i if i % 5 else None, 1000.0 * lot + rng.random() * 1000)) for i, lot in enumerate(sorted(rng.randrange(3) for _ in range(120)))]
    got = run(spark, tmp_path, "timers", rows, "id long, at double", 3, lambda s: state.expiries(s, 800 / 86400))
    latest = max(at for _, (_, at) in rows)
    assert sorted(r.id for r in got) == [i for _, (i, at) in rows if i is not None and at < latest - 800]
