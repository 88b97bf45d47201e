"""Knobs of matching, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    threshold: float = 80.0
    price_tolerance: float = 1.0
    price_bonus: float = 10.0
    automatic_cap: float = 98.0
    candidates: int = 8
    anchor_ratio: float = 80.0
    ignored_ratio: float = 90.0
    controlled_ratio: float = 88.0
    party_ratio: float = 75.0
    green_over: float = 90.0
    yellow_from: float = 70.0
