"""Thresholds of the operators; the defaults are those of live markets."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Trailing windows of the trade metrics, in ms.
WINDOWS = {"1m": 60_000, "5m": 300_000, "15m": 900_000}
BEARISH_CONFLICTS = ("POSSIBLE_BEARISH_ABSORPTION", "CONFIRMED_BEARISH_ABSORPTION", "BEARISH_DIVERGENCE", "SELL_AGGRESSION")
BULLISH_CONFLICTS = ("POSSIBLE_BULLISH_ABSORPTION", "CONFIRMED_BULLISH_ABSORPTION", "BULLISH_DIVERGENCE", "BUY_AGGRESSION")
#: Events that no cooldown holds back.
UNCOOLED = ("LARGE_TRADE", "SWEEP_CONFLUENCE", "LOW_CONFLUENCE")


@dataclass(frozen=True)
class Config:
    """All thresholds by name; ``Config.from_env`` overrides them by TIDEMARK_<NAME>."""

    large_trade: float = 100_000.0
    aggression: float = 0.65
    confirm_imbalance: float = 0.15
    burst_multiple: float = 3.0
    burst_floor: float = 5.0
    burst_recent_ms: int = 10_000
    burst_back_ms: int = 300_000
    absorption_short: float = 200_000.0
    absorption_long: float = 500_000.0
    absorption_ratio: float = 0.60
    flat_pct: float = 0.02
    least_trades: int = 10
    divergence: float = 500_000.0
    divergence_trades: int = 20
    cooldown_ms: int = 60_000
    cooldown_move: float = 0.0005
    stale_ms: int = 3_000
    sweep_pressure: float = 250_000.0
    sweep_recovery: float = 50_000.0
    sweep_score: int = 7
    sweep_active_ms: int = 60_000
    alert_ms: int = 900_000
    conflict_ms: int = 300_000
    bias_delta: float = 100_000.0
    watch_delta: float = 50_000.0
    signal_cooldown_ms: int = 180_000
    wall_least: float = 250_000.0
    wall_multiple: float = 3.0
    vacuum_share: float = 0.25
    iceberg_multiple: float = 2.5
    spoof_pulled: float = 300_000.0
    spoof_ms: int = 10_000
    spoof_executed: float = 0.05
    block_ms: int = 3_600_000

    @classmethod
    def from_env(cls, prefix: str = "TIDEMARK_", env: dict | None = None) -> Config:
        env = os.environ if env is None else env
        found = {f.name: type(f.default)(float(env[prefix + f.name.upper()])) for f in fields(cls) if prefix + f.name.upper() in env}
        return cls(**found)
