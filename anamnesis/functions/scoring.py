"""Scores and numbers of memories: recency, boosts, rank scores, calibrated and adaptive k."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ADAPTIVE_EDGES, ADAPTIVE_K, CALIBRATED_K


def recency(age_hours: Column, decay_days: float) -> Column:
    """1 - age / horizon within [0.5, 1]; 0.5 where there is no horizon."""
    if decay_days <= 0:
        return F.lit(0.5)
    return F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1.0 - age_hours / (24.0 * decay_days)))


def similarity_score(cosine: Column, same_agent: Column, boost: float) -> Column:
    return F.when(same_agent, cosine * boost).otherwise(cosine)


def rank_score(similarity: Column, rec: Column, mode: str) -> Column:
    return similarity * rec if mode == "legacy" else similarity + 0.001 * rec


def visible(memory_agent: Column, query_agent: Column) -> Column:
    """Global rows are seen by all, an agent's rows by that agent."""
    return memory_agent.isNull() | ((query_agent != "") & (memory_agent == query_agent))


def _by_setting(coverage: Column, mode: Column, table: dict, value) -> Column:
    out = F.lit(0)
    for (c, m), v in table.items():
        out = F.when((coverage == c) & (mode == m), value(v)).otherwise(out)
    return out


def calibrated_k(coverage: Column, mode: Column) -> Column:
    return _by_setting(coverage, mode, CALIBRATED_K, F.lit)


def adaptive_bin(top1: Column, mode: Column) -> Column:
    """0, 1 or 2 by the similarity of the first result; the edges belong to the lower bin."""
    out = F.lit(None)
    for m, (low, high) in ADAPTIVE_EDGES.items():
        out = F.when(mode == m, F.when(top1 <= low, 0).when(top1 <= high, 1).otherwise(2)).otherwise(out)
    return out


def adaptive_k(top1: Column, coverage: Column, mode: Column) -> Column:
    """The bin's number, at least the calibrated one; the calibrated one where nothing similar was found."""
    place = adaptive_bin(top1, mode)
    per_bin = _by_setting(coverage, mode, ADAPTIVE_K, lambda v: F.element_at(F.array(*map(F.lit, v)), place + 1))
    base = calibrated_k(coverage, mode)
    return F.when(top1 > 0, F.greatest(per_bin, base)).otherwise(base)


def guarded(top_k: Column, max_context: Column, history: Column, max_inject: Column) -> tuple[Column, Column]:
    """(k, injection budget) under the context's limit."""
    budget = F.greatest(F.lit(0), max_context - history)
    per_memory = F.greatest(F.lit(1), F.floor(max_inject / F.greatest(F.lit(1), top_k)))
    k = F.when(budget < max_inject, F.greatest(F.lit(1), F.floor(budget / per_memory))).otherwise(top_k)
    return k.cast("int"), F.least(max_inject, budget).cast("int")
