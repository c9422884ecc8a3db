"""Embedding and fact extraction with models that are handed in, in bounded batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import FACTS, estimate, facts_in_reply, sentence_spans

Model = Callable[[list[str]], np.ndarray]
MOST_TEXTS, MOST_TOKENS = 8, 2048


def batches_of(texts: list[str], most_texts: int = MOST_TEXTS, most_tokens: int = MOST_TOKENS) -> Iterator[list[str]]:
    """Runs of at most ``most_texts`` texts and about ``most_tokens`` tokens; a longer text goes alone, cut to the limit, as a model reads no more."""
    batch: list[str] = []
    used = 0
    for t in texts:
        t = t.encode()[: most_tokens * 4 - 4].decode(errors="ignore")
        if batch and (len(batch) == most_texts or used + estimate(t) > most_tokens):
            yield batch
            batch, used = [], 0
        batch.append(t)
        used += estimate(t)
    if batch:
        yield batch


def isolated(model: Model, batch: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
    """(vector, reason) of each text: a batch that fails is halved until the texts that fail stand alone; those have no vector.

    A model that fails on one of n texts is called about 2 log2(n) times more. A reply of another number of vectors, or with numbers that aren't finite, is a failure too.
    """
    try:
        rows = np.asarray(model(batch), float)
        if len(rows) != len(batch):
            raise ValueError(f"{len(rows)} vectors for {len(batch)} texts")
        if np.isfinite(rows).all():
            return [(v, None) for v in rows]
        if len(batch) == 1:
            raise ValueError("a vector that isn't finite")
    except Exception as e:  # whatever a model raises
        if len(batch) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(batch) // 2
    return isolated(model, batch[:half]) + isolated(model, batch[half:])


def embedder(model: Model, most_texts: int = MOST_TEXTS, most_tokens: int = MOST_TOKENS, reasons: bool = False):
    """A column function text -> unit vector, null where the model fails; with ``reasons``, text -> struct(vector, reason)."""

    def unit(v: np.ndarray | None) -> np.ndarray | None:
        return None if v is None else (v / n if (n := np.sqrt(v @ v)) > 0 else v).astype(np.float32)

    def found(texts: pd.Series) -> list[tuple[np.ndarray | None, str | None]]:
        return [(unit(v), why) for batch in batches_of([t or "" for t in texts], most_texts, most_tokens) for v, why in isolated(model, batch)]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([v for v, _ in found(texts)], dtype=object)

    @F.pandas_udf("vector array<float>, reason string")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = found(texts)
            yield pd.DataFrame({"vector": pd.Series([v for v, _ in rows], dtype=object), "reason": pd.Series([why for _, why in rows], dtype=object)})

    return told if reasons else run


def hashing_model(dim: int = 64) -> Model:
    """A stand-in model: signed counts of hashed words."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 16 & 1 else -1
        return out

    return run


def fact_extractor(model: Callable[[list[str]], list[str]]):
    """A column function prompt -> facts of the model's reply."""

    @F.pandas_udf(FACTS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            yield pd.Series([facts_in_reply(r) for r in model([p or "" for p in prompts])], dtype=object)

    return run


class SentenceRows:
    """The sentences of a text as rows, with their byte spans."""

    def eval(self, text: str):
        for i, (start, end) in enumerate(sentence_spans(text)):
            yield i, start, end


def register(spark) -> None:
    """Names for SQL users. ``sentence_rows`` is a table function: FROM t, LATERAL sentence_rows(t.text)."""
    from .text import parse_facts, split_sentences

    spark.udtf.register("sentence_rows", F.udtf(SentenceRows, returnType="idx int, start_byte int, end_byte int", useArrow=True))
    spark.udf.register("split_sentences", split_sentences)
    spark.udf.register("parse_facts", parse_facts)
    spark.udf.register("embed_text", embedder(hashing_model()))
