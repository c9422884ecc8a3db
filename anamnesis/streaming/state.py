"""Streams with state of their own: expiry by timers, replies put together as they arrive, a cache of recent blocks.

All of them keep their state in Spark's state store, so they go on after a restart from their checkpoint. What a key holds is bounded: a
time, the chunks that came too early, or a cache's capacity.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def expiries(stored: DataFrame, ttl_days: float) -> DataFrame:
    """(id): what expires, of a stream (id, at) in seconds, once the latest time seen lies over ``ttl_days`` after ``at``. Rows without an id move the clock only.

    The watermark trails by the time to live, so each id's timer is its own time, and a row that comes too late for the watermark has
    expired before it came (``Saver`` tells those apart itself).
    """
    clock = stored.select("id", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("at")).withWatermark("at", f"{round(ttl_days * 86_400_000)} milliseconds")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]]})
            return
        at = min(int(p["at"].min().timestamp() * 1000) for p in parts)
        if key[0] is None or pd.isna(key[0]):
            return
        if state.exists:
            at = min(at, state.get[0])
        state.update((at,))
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))

    return clock.groupBy("id").applyInPandasWithState(step, "id long", "at long", "append", GroupStateTimeout.EventTimeTimeout)


def delta(line: str) -> str:
    """The text that a line of a reply adds, in either wire format."""
    if not line.startswith("data: ") or line == DONE:
        return ""
    try:
        data = json.loads(line[6:])
    except ValueError:
        return ""
    choices = data.get("choices") if isinstance(data, dict) else None
    found = ((choices[0].get("delta") or {}).get("content") if isinstance(choices[0], dict) else None) if isinstance(choices, list) and choices else None
    if found is None and isinstance(data, dict) and isinstance(data.get("delta"), dict) and data["delta"].get("type") == "text_delta":
        found = data["delta"].get("text")
    return found if isinstance(found, str) else ""


#: Fixed value: the line that ends a reply.
DONE = "data: [DONE]"


def replies(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, text, done): what the chunks of a stream (stream_id, seq, chunk) add to each reply, up to chunk ``seq``, as they come.

    Chunks are numbered from 0 and may be cut anywhere, also within a line; one that comes early waits for those before it, one that comes again is
    left out. After the end mark nothing is added.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, line, done, waiting = state.get if state.exists else (0, "", False, "{}")
        early = {int(k): v for k, v in json.loads(waiting).items()}
        for p in parts:
            early |= {int(s): c or "" for s, c in zip(p["seq"], p["chunk"]) if s >= upto}
        text, before = "", upto
        while upto in early:
            line += early.pop(upto)
            upto += 1
            *whole, line = line.split("\n")
            for one in whole:
                one = one.removesuffix("\r")
                done = done or one == DONE
                text += "" if done else delta(one)
            if line == DONE:
                done, line = True, ""
        if done:
            early, line = {}, ""
        state.update((upto, line, done, json.dumps(early)))
        if upto > before and (text or done):
            yield pd.DataFrame({"stream_id": [key[0]], "seq": [upto - 1], "text": [text], "done": [done]})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, text string, done boolean", "upto long, line string, done boolean, waiting string", "append", GroupStateTimeout.NoTimeout)


#: Requests of a cache that Python has at once.
AT_ONCE = 20_000


def recent_blocks(requests: DataFrame, capacity: int) -> DataFrame:
    """(request_id, hit, block): requests (cache, request_id, key, block) against the ``capacity`` keys of each cache that were used last.

    Requests count in the order of their ids. One whose key is cached gets the block that was cached and moves the key to the end; any other puts its own block
    in, and the key that wasn't used for longest goes.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OrderedDict(json.loads(state.get[0]) if state.exists else [])
        # as Arrow, which takes a few bytes a row beside its texts; Python has a slice of them at a time
        schema = pa.schema([("request_id", pa.int64()), ("key", pa.large_string()), ("block", pa.large_string())])
        rows = pa.Table.from_batches([pa.RecordBatch.from_pandas(p[schema.names], schema, preserve_index=False) for p in parts], schema)
        order = pc.sort_indices(rows, [("request_id", "ascending")])
        for at in range(0, len(order), AT_ONCE):
            some = rows.take(order[at : at + AT_ONCE]).to_pydict()
            hits, blocks = [], []
            for name, block in zip(some["key"], some["block"]):
                hits.append(name in held)
                if name in held:
                    held.move_to_end(name)
                else:
                    held[name] = block
                    if len(held) > capacity:
                        held.popitem(last=False)
                blocks.append(held.get(name, block))
            if at + AT_ONCE >= len(order):
                state.update((json.dumps(list(held.items())),))
            yield pd.DataFrame({"request_id": some["request_id"], "hit": hits, "block": blocks})

    return requests.groupBy("cache").applyInPandasWithState(step, "request_id long, hit boolean, block string", "held string", "append", GroupStateTimeout.NoTimeout)
