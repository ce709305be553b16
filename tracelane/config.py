"""Thresholds and weights of the analysis, and the key under which its results are kept."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

#: Of the results; raised when their meaning changes.
ENGINE_VERSION = "2"


@dataclass(frozen=True)
class Weights:
    """Of the five components of a bottleneck score; only their proportions count."""

    median_wait: float = 0.30
    p90_wait: float = 0.20
    processing: float = 0.10
    case_coverage: float = 0.20
    wait_share: float = 0.20

    def __post_init__(self):
        if min(asdict(self).values()) < 0:
            raise ValueError("weights must not be negative")


@dataclass(frozen=True)
class AnalysisConfig:
    weights: Weights = field(default_factory=Weights)
    high: float = 0.60
    medium: float = 0.35
    #: Activities (and slow transitions) with fewer events are not scored.
    min_activity_support: int = 10
    #: A transition is long beyond Q3 + iqr_factor * (Q3 - Q1), and never below min_long_hours.
    iqr_factor: float = 3.0
    min_long_hours: float = 1.0
    min_transition_support: int = 20
    #: Activities that end a completed case; None: those that end at least completion_share of the cases.
    completion: tuple[str, ...] | None = None
    completion_share: float = 0.02

    def key(self) -> str:
        """16 hex digits, equal for equal settings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


DEFAULT = AnalysisConfig()
