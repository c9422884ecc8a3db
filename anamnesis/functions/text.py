"""Text by bytes: token estimates, safe truncation, sentences, query-aware compression, fact keys and replies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("idx", "start_byte", "end_byte")]))
FACTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "attribute", "value")]))

#: The block around remembered lines, and its parts.
HEADER, FOOTER = "<memory context>\nRelevant past interactions:\n", "</memory context>"
FACTS_HEADER, MEMORIES_HEADER = "Known facts (latest values):\n", "Relevant conversation memories:\n"

#: The longest sentence and the shortest that stands alone, in bytes; the mark of a gap.
LONGEST, SHORTEST, GAP = 300, 20, " … "

#: The most facts of one reply, and the most bytes of a component.
MOST_FACTS, MOST_FACT_BYTES = 10, 400


def tokens(text: Column) -> Column:
    """The estimate: a quarter of the bytes, and one."""
    return F.floor(F.octet_length(text) / 4).cast("long") + 1


def estimate(text: str) -> int:
    return len(text.encode()) // 4 + 1


def count_tokens(counter=None):
    """A column function text -> tokens by a counter (text -> number or None); the estimate where there is none or it fails."""
    if counter is None:
        return tokens

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        counted = [(t, None if t is None else counter(t)) for t in texts]
        return pd.Series([None if t is None else n if n is not None and n >= 0 else estimate(t) for t, n in counted], dtype="Int64")

    return run


def truncate_utf8(text: Column, most: int) -> Column:
    """At most ``most`` bytes of whole characters with '...' after them; a text that fits stays as it is."""
    raw = F.encode(text, "UTF-8")
    inner = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
    end = most
    cut = F.when(~inner(end), end)
    for back in (1, 2):
        cut = cut.when(~inner(end - back), end - back) if end - back >= 0 else cut
    cut = cut.otherwise(max(end - 3, 0))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substring(raw, F.lit(1), cut).cast("string"), F.lit("...")))


def cut_utf8(text: str, most: int) -> str:
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore") + "..."


def memory_line(user: Column, assistant: Column, created: Column, now: float, most: int = 400, absolute: bool = False) -> Column:
    from .temporal import time_ago, utc_date

    ago = time_ago(F.lit(now) - created)
    stamp = F.concat(utc_date(created), F.lit(", "), ago) if absolute else ago
    return F.concat(F.lit("- ["), stamp, F.lit("] "), truncate_utf8(user, most), F.lit(" Response: "), truncate_utf8(assistant, most))


def sticky_line(user: Column, assistant: Column, created: Column, most: int = 400) -> Column:
    from .temporal import utc_date

    return F.concat(F.lit("- ["), utc_date(created), F.lit("] "), truncate_utf8(user, most), F.lit(" Response: "), truncate_utf8(assistant, most))


def fact_line(subject: Column, attribute: Column, value: Column, created: Column, now: float) -> Column:
    from .temporal import time_ago

    return F.concat(F.lit("- "), subject, F.lit(" "), attribute, F.lit(": "), value, F.lit(" (as of "), time_ago(F.lit(now) - created), F.lit(")"))


def longest_line_tokens(most: Column, absolute: bool = False) -> Column:
    """The tokens of a memory line whose sides are both cut: dash, time, brackets, two sides with dots, ' Response: ' and line feed."""
    size = 3 + (22 if absolute else 10) + 2 + 2 * (most + 3) + 11 + 1
    return F.floor(size / 4).cast("int") + 1


def required_tokens(k: Column, most: Column, absolute: bool = False) -> Column:
    """The budget for k lines of any length with header and footer."""
    return k * longest_line_tokens(most, absolute) + estimate(HEADER) + estimate(FOOTER)


def normalised_component(text: Column) -> Column:
    """One space between words, none around them, ASCII capitals made small."""
    return F.translate(F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fact_key(subject: Column, attribute: Column) -> Column:
    return F.concat_ws("|", normalised_component(subject), normalised_component(attribute))


def fact_prompt(user: Column, assistant: Column) -> Column:
    #: Fixed value: the request for facts of an exchange.
    ask = "Extract only durable facts about the user or project from this single exchange. Return ONLY a JSON array of objects with subject, attribute, and value string fields; return [] if none. Do not infer uncertain facts."
    return F.concat(F.lit(f"{ask}\nUser: "), user, F.lit("\nAssistant: "), assistant)


# Sentences. Spans are in bytes of UTF-8; white space and digits are ASCII's.

_SPACE = b" \t\n\x0b\x0c\r"
_BULLET = re.compile(rb"[ \t]*(?:[-*+]|[0-9]\.)")
_ENDS = re.compile(rb"[^.!?]*[.!?]|[^.!?]+")


def _trimmed(raw: bytes, a: int, b: int) -> tuple[int, int]:
    part = raw[a:b]
    a += len(part) - len(part.lstrip(_SPACE))
    return (a, a + len(part.strip(_SPACE)))


def _pieces(raw: bytes, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A span in pieces of at most LONGEST bytes, cut after white space where there is some, never inside a character."""
    while b - a > LONGEST:
        cut = a + LONGEST
        while cut > a and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        space = next((i for i in range(cut, a, -1) if raw[i - 1] in _SPACE), a)
        cut = space if space > a else cut
        yield _trimmed(raw, a, cut)
        a = cut
        while a < b and raw[a] in _SPACE:
            a += 1
    yield _trimmed(raw, a, b)


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Byte spans of a text's sentences: fenced code and bullet lines stay whole, short fragments join their neighbours."""
    raw = (text or "").encode()
    spans: list[tuple[int, int]] = []
    at, fenced = 0, None
    for line in raw.split(b"\n"):
        a, b = _trimmed(raw, at, at + len(line))
        at += len(line) + 1
        fence = raw[a:b].startswith(b"```")
        if fenced is not None:
            if fence:
                spans += _pieces(raw, fenced, b)
                fenced = None
        elif fence:
            fenced = a
        elif a < b and _BULLET.match(raw, a, b):
            spans += _pieces(raw, a, b)
        else:
            for m in _ENDS.finditer(raw, a, b):
                spans += _pieces(raw, *m.span())
    if fenced is not None:
        spans += _pieces(raw, fenced, len(raw))
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if a >= b:
            continue
        if b - a < SHORTEST and merged:
            merged[-1] = merged[-1][0], b
        else:
            merged.append((a, b))
    if len(merged) > 1 and merged[0][1] - merged[0][0] < SHORTEST:
        merged[:2] = [(merged[0][0], merged[1][1])]
    return merged


@F.pandas_udf(SPANS)
def split_sentences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"idx": i, "start_byte": a, "end_byte": b} for i, (a, b) in enumerate(sentence_spans(t))])


def compressed(text: str, sentences: list[tuple[int, int, int, list[float] | None]], query: list[float] | None, most: int) -> str:
    """The sentences nearest to the query that fit into ``most`` bytes, in text order; (idx, start, end, vector) each."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    good = [s for s in sentences or [] if 0 <= s[1] < s[2] <= len(raw) and s[3] is not None and len(s[3])]
    if query is None or not len(query) or not good:
        return cut_utf8(text, most)
    q = np.asarray(query, float)

    def nearness(v) -> float:
        v = np.asarray(v, float)
        n = np.sqrt((q @ q) * (v @ v)) if len(v) == len(q) else 0.0
        return float(q @ v) / n if n > 0 else -1.0

    def joined(chosen: list) -> bytes:
        out = b""
        for before, s in zip([None, *chosen], chosen):
            out += (b"" if before is None else b" " if s[0] == before[0] + 1 else GAP.encode()) + raw[s[1] : s[2]]
        return out

    chosen: list = []
    for s in sorted(good, key=lambda s: (-nearness(s[3]), s[0])):
        more = sorted([*chosen, s], key=lambda s: s[0])
        if len(joined(more)) <= most:
            chosen = more
    return joined(chosen).decode() if chosen else cut_utf8(text, most)


def compress_side(most: int):
    """A column function (text, sentences array<struct<idx,start_byte,end_byte,embedding>>, query array<float>) -> string."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, sentences: pd.Series, queries: pd.Series) -> pd.Series:
        rows = [
            None if t is None else compressed(t, [(s["idx"], s["start_byte"], s["end_byte"], s["embedding"]) for s in (ss if ss is not None else [])], q, most)
            for t, ss, q in zip(texts, sentences, queries)
        ]
        return pd.Series(rows, dtype=object)

    return run


def facts_in_reply(reply: str | None) -> list[dict]:
    """The facts of the JSON array in a reply: objects with three texts, cut to a size, ten at most; none if it can't be read."""
    reply = reply or ""
    a, b = reply.find("["), reply.rfind("]")
    try:
        found = json.loads(reply[a : b + 1]) if 0 <= a < b else []
    except ValueError:
        return []
    out = []
    for x in found if isinstance(found, list) else []:
        parts = [x.get(k) for k in ("subject", "attribute", "value")] if isinstance(x, dict) else []
        if len(parts) == 3 and all(isinstance(p, str) and p for p in parts):
            cut = [p.encode()[:MOST_FACT_BYTES].decode(errors="ignore") for p in parts]
            out.append(dict(zip(("subject", "attribute", "value"), cut)))
        if len(out) == MOST_FACTS:
            break
    return out


@F.pandas_udf(FACTS)
def parse_facts(replies: pd.Series) -> pd.Series:
    return replies.map(facts_in_reply)


# Structured message content.


def block_texts(content) -> list[str]:
    """Texts of text and tool-result blocks, nested ones included."""
    if isinstance(content, str):
        return [content]
    out: list[str] = []
    for block in content if isinstance(content, list) else []:
        if isinstance(block, dict):
            if block.get("type") == "text" and isinstance(block.get("text"), str):
                out.append(block["text"])
            elif block.get("type") == "tool_result":
                out += block_texts(block.get("content"))
    return out


@F.pandas_udf(T.StringType())
def last_user_content(bodies: pd.Series) -> pd.Series:
    """The text of the last user message of a request body whose content is a text or blocks."""

    def one(body):
        try:
            messages = json.loads(body or "{}").get("messages")
        except (ValueError, AttributeError):
            return ""
        users = [m for m in messages if isinstance(m, dict) and m.get("role") == "user" and "content" in m] if isinstance(messages, list) else []
        return "".join(block_texts(users[-1]["content"])) if users else ""

    return bodies.map(one)


def inject_blocks(mode: str):
    """A column function (request body, context) -> body with the context in the system text, or before the last user's content."""

    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(body, context):
            data = json.loads(body)
            if not context:
                return body
            users = [m for m in data.get("messages", []) if m.get("role") == "user"]
            block = {"type": "text", "text": context}
            place, key = (users[-1] if users else {}, "content") if mode == "suffix" else (data, "system")
            now = place.get(key)
            if isinstance(now, str):
                place[key] = f"{now}\n\n{context}" if key == "system" else f"{context}\n\n{now}"
            elif isinstance(now, list):
                place[key] = [*now, block] if key == "system" else [block, *now]
            elif key == "system" and key not in data:
                data[key] = context
            return json.dumps(data, ensure_ascii=False, separators=(",", ":"), sort_keys=True)

        return pd.Series([one(b, c) for b, c in zip(bodies, contexts)], dtype=object)

    return run
