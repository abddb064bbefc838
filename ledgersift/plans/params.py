"""Parameters of the operators; defaults are those of a real engagement, LEDGER those that suit the given tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    period_end: dt.date = dt.date(2000, 12, 31)
    window_days: int = 5
    post_close_days: int = 10
    round_multiple: int = 1000
    round_min: int = 10000
    balance_tolerance: float = 0.01
    match_days: int = 10
    reversal_tolerance: float = 0.01
    rare_threshold: int = 5
    gap_days: int = 5
    split_days: int = 14
    split_count: int = 3
    split_threshold: int = 10000
    split_ratio: float = 0.9
    account_share: float = 0.10
    min_baseline: int = 1
    exclude_flagged: bool = True
    # fixed values: entry types and user patterns that tell manual from system entries
    manual_types: tuple[str, ...] = ("manual", "man", "m")
    system_users: tuple[str, ...] = ("SAP*", "WF-BATCH", "BATCH*", "SYSTEM", "AUTO*", "JOB*", "INTERFACE*", "*_RFC")
    high_risk_users: tuple[str, ...] = ()
    materiality: float = 175000.0
    universe_cap: int = 200
    overflow: str = "pause"
    top_n: int = 20
    minimum_per_currency: int = 1
    forced: tuple[str, ...] = ()
    base_currency: str = "USD"
    fx: tuple[tuple[str, float], ...] = ()
    sample_size: int = 25
    seed: int = 42
    pack_size: int = 20
    min_confidence: float = 0.6
    reject_limit: float = 0.02
    redact: tuple[str, ...] = ()
    declared_through: dt.date | None = None


LEDGER = Params(
    round_multiple=100, gap_days=1500, split_threshold=50000, split_ratio=0.7, split_days=30, balance_tolerance=100000, rare_threshold=270, high_risk_users=("U5", "U7", "SAP1", "SAP2"), account_share=0.01,
    reversal_tolerance=200, match_days=30, materiality=100000.0, universe_cap=2000, forced=("JPY",), fx=(("EUR", 1.08), ("GBP", 1.27), ("JPY", 0.0091), ("MAD", 0.1)), declared_through=dt.date(2002, 1, 31), redact=("Licensed under", "All rights"),
)
