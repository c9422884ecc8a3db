"""Settings of the engine, validated on construction."""

from __future__ import annotations

import argparse
import dataclasses
import math
from dataclasses import dataclass
from enum import Enum


class DecayMode(Enum):
    TIEBREAK = "tiebreak"
    LEGACY = "legacy"


class InjectMode(Enum):
    SYSTEM = "system"
    SUFFIX = "suffix"
    STICKY = "sticky"

    @classmethod
    def parse(cls, name: str) -> InjectMode:
        """An unknown name means SYSTEM."""
        return next((m for m in cls if m.value == name), cls.SYSTEM)


#: Calibrated numbers of memories by (coverage, decay mode).
CALIBRATED_K = {(0.8, "tiebreak"): 4, (0.9, "tiebreak"): 8, (0.95, "tiebreak"): 16, (0.8, "legacy"): 7, (0.9, "legacy"): 15, (0.95, "legacy"): 26}

#: Upper edges of the lower two similarity bins by decay mode.
ADAPTIVE_EDGES = {"tiebreak": (0.6318194, 0.7150962), "legacy": (0.6065812, 0.6967925)}

#: Numbers of memories per similarity bin by (coverage, decay mode).
ADAPTIVE_K = {
    (0.8, "tiebreak"): (9, 3, 2), (0.9, "tiebreak"): (21, 7, 4), (0.95, "tiebreak"): (49, 14, 5),
    (0.8, "legacy"): (20, 4, 3), (0.9, "legacy"): (35, 8, 5), (0.95, "legacy"): (69, 17, 7),
}

@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    min_score: float = 0.3
    decay_days: float = 30.0
    decay_mode: DecayMode = DecayMode.TIEBREAK
    agent_boost: float = 1.2
    temporal_boost: float = 0.0
    rrf_k: int = 60
    dedup_threshold: float = 0.92
    max_per_agent: int = 1000
    max_global: int = 5000
    ttl_days: float = 0.0
    max_inject_tokens: int = 1024
    max_context_tokens: int = 4096
    memory_line_chars: int = 400
    inject_mode: InjectMode = InjectMode.SYSTEM
    sticky_entries: int = 1000
    max_facts: int = 5
    fact_queue_size: int = 64
    target_coverage: float = 0.0
    adaptive_k: bool = False
    history_budget: int = 0
    history_trim_ratio: float = 0.5

    def __post_init__(self) -> None:
        wrong = [
            why
            for bad, why in (
                (self.sticky_entries < 0, "sticky_entries is 0 or more"),
                (self.max_facts < 0, "max_facts is 0 or more"),
                (self.fact_queue_size <= 0, "fact_queue_size is positive"),
                (self.decay_days <= 0, "decay_days is positive"),
                (self.rrf_k <= 0, "rrf_k is positive"),
                (self.temporal_boost < 0, "temporal_boost is 0 or more"),
                (self.target_coverage not in (0, 0.8, 0.9, 0.95), "target_coverage is 0, 0.8, 0.9 or 0.95"),
                (self.memory_line_chars <= 0, "memory_line_chars is positive"),
                (self.history_budget < 0, "history_budget is 0 or more"),
                (not (math.isfinite(self.history_trim_ratio) and 0 < self.history_trim_ratio <= 1), "history_trim_ratio is above 0 and at most 1"),
                (self.adaptive_k and not self.target_coverage, "adaptive_k needs target_coverage"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))

    @classmethod
    def parse(cls, args: list[str]) -> Settings:
        """Settings from command-line options named after the fields."""
        parser = argparse.ArgumentParser(prog="anamnesis")
        kinds = {"int": int, "float": float, "bool": lambda x: x.lower() in ("1", "true", "yes"), "DecayMode": DecayMode, "InjectMode": InjectMode.parse}
        for f in dataclasses.fields(cls):
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=kinds[f.type], default=f.default)
        return cls(**vars(parser.parse_args(args)))


#: The moment at which the registered queries run: 2024-03-14T15:00Z.
NOW = 1710428400.0
