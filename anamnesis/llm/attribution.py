"""Operator 3, token counts by offset-mapped attribution.

A document is encoded once, as a whole, by a byte-level vocabulary, whose tokens'
bytes put together are the text. So each token has an exact span, and tokens and
sections are two sorted lists of intervals, which are merged by binary search. No
section is ever encoded on its own, so the counts add up to the document's.

A token that crosses a boundary goes by an explicit rule: ``start`` gives it to
the section of its first byte, ``end`` to that of its last, ``split`` to all of them by
their shares of its bytes.

Defined results: a null or empty text has one empty section without tokens; runs of white space may
be of any length; repeated rows are counted each on its own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RULES = ("start", "end", "split")

#: White space by the library's pattern, and a length of runs that it surely can look back over.
SPACE, LONGEST_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 10_000


@cache
def encoder(vocab_path: str):
    """The encoder of a rank file and the byte length of each of its tokens."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(vocab_path, "rb"))}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("attribution", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(text: str, vocab_path: str, longest: int = LONGEST_SPACE) -> list[int]:
    """The ids of a text, however long its runs of white space.

    The library's pattern looks back over a whole run of white space and ends the process on very long ones. What it takes
    from a run that other text follows is all but the last character, as one piece, so such runs are cut out there.
    """
    enc = encoder(vocab_path)[0]
    if len(text) <= longest:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for m in re.finditer(f"[{SPACE}]{{{longest + 1},}}", text):
        ids += enc.encode_ordinary(text[at : m.start()])
        at = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() < at:
            ids += enc._encode_single_piece(text[m.start() : at])
    return ids + enc.encode_ordinary(text[at:])


def token_ends(text: str, vocab_path: str) -> np.ndarray:
    """Where each token ends, in bytes."""
    return np.cumsum(encoder(vocab_path)[1][np.array(encode(text, vocab_path), np.int64)])


def line_starts(raw: bytes) -> np.ndarray:
    """Sections are lines with the line feed that ends them; a text's last section may be empty only if it is the only one."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], at[at < len(raw)]])


def starts_by(pattern: str):
    """Sections that begin wherever a pattern matches, and at 0."""
    find = re.compile(pattern.encode())
    return lambda raw: np.unique([0, *(m.start() for m in find.finditer(raw) if m.start() < len(raw))])


def attribute(ends: np.ndarray, starts: np.ndarray, size: int, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and tokens that began in the section and end beyond it."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    n = len(starts)
    crossing = np.bincount(first[first != last], minlength=n)
    if rule != "split":
        return np.bincount(first if rule == "start" else last, minlength=n).astype(float), crossing
    counts = np.bincount(first[first == last], minlength=n).astype(float)
    limits = np.append(starts, size)
    for t in np.flatnonzero(first != last):
        for s in range(first[t], last[t] + 1):
            counts[s] += (min(ends[t], limits[s + 1]) - max(begins[t], limits[s])) / (ends[t] - begins[t])
    return counts, crossing


def section_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", pattern: str | None = None) -> DataFrame:
    """(id, section, char_start, char_end, n_tokens, crossing, doc_tokens): a row per section of each whole text.

    Sections are lines, or begin at the matches of ``pattern``. n_tokens is a count, or a sum of shares under ``split``.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = starts_by(pattern) if pattern else line_starts
        for batch in batches:
            rows, parts = [], []

            def out() -> pa.RecordBatch:
                at, *cols = (np.concatenate(c) for c in zip(*parts))
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, cols)], [id_col, "section", "char_start", "char_end", "n_tokens", "crossing", "doc_tokens"])

            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                raw = text.encode()
                starts, ends = cut(raw), token_ends(text, vocab_path)
                counts, crossing = attribute(ends, starts, len(raw), rule)
                limits = np.append(starts, len(raw))
                if len(raw) != len(text):  # bytes to characters: continuation bytes don't count
                    limits = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[limits]
                n = len(starts)
                parts.append((np.full(n, i), np.arange(n), limits[:-1].astype(np.int64), limits[1:].astype(np.int64), counts, crossing, np.full(n, len(ends))))
                rows.append(n)
                if sum(rows) > 50_000:
                    yield out()
                    rows, parts = [], []
            if parts:
                yield out()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, section long, char_start long, char_end long, n_tokens double, crossing long, doc_tokens long")
