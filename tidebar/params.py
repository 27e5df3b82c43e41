"""Parameters of indicators and studies: plain driver-side values."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Fixed values of the studies.
HORIZONS = (1, 3, 6, 12, 24, 48)
EXTRA_HORIZONS = (36, 60, 72)
RUN_BUCKETS = (1, 3, 5, 10, 20)
COSTS_BPS = (1.0, 2.0, 5.0, 11.0)
LOOKBACKS = (3, 6, 12)
INTERVAL_MINUTES = {"5m": 5, "15m": 15, "1h": 60, "4h": 240}
BOOTSTRAP_ROUNDS, BOOTSTRAP_SEED = 10_000, 20260908
WARMUP_STUDY, WARMUP_LEADER = 101, 500
NEIGHBOUR_CUT, MAX_CANDIDATES = 0.30, 3
MIN_SAMPLE = 20


def windows(params) -> dict[str, int]:
    """The lengths among a parameter set's fields."""
    return {f.name: getattr(params, f.name) for f in fields(params) if f.name.endswith("length")}


class _Windows:
    """Parameter sets whose lengths must hold LEAST bars."""

    LEAST = 1

    def __post_init__(self):
        if short := sorted(name for name, n in windows(self).items() if n < self.LEAST):
            raise ValueError(f"{', '.join(short)} must be at least {self.LEAST}")

    @property
    def longest(self) -> int:
        return max(windows(self).values())


# Defaults of the three indicators: fixed values.


@dataclass(frozen=True)
class SqueezeParams(_Windows):
    """Channel, range, momentum, smoothing. use_true_range: the channel's range is the true range, else high - low."""

    LEAST = 2

    bb_length: int = 20
    bb_mult: float = 2.0
    kc_length: int = 20
    kc_mult: float = 1.5
    use_true_range: bool = True
    momentum_length: int = 20
    atr_length: int = 100

    @property
    def warmup(self) -> int:
        """Bars before the first that has every window full and a bar before it."""
        return self.longest + 1

    @property
    def lookback(self) -> int:
        """Bars that a chunk carries: momentum regresses over deviations that look back as far again."""
        return max(self.longest, 2 * self.momentum_length) + 2


@dataclass(frozen=True)
class WaveTrendParams(_Windows):
    channel_length: int = 10
    average_length: int = 21
    signal_length: int = 4
    oversold: float = -53.0
    overbought: float = 53.0


@dataclass(frozen=True)
class AdxParams(_Windows):
    length: int = 14
    threshold: float = 20.0
    secondary: float = 25.0
