"""Indicators as functions of bars: squeeze momentum, WaveTrend and ADX.

Each takes bars (symbol, interval, bar_index, open, high, low, close, ..) and
returns them with its columns; flags are never null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions import scan
from tidebar.functions import series as s
from tidebar.operators.causality import lined, reaching
from tidebar.params import AdxParams, SqueezeParams, WaveTrendParams

REQUIRED = ("open", "high", "low", "close")


def check_columns(bars: DataFrame) -> None:
    if missing := sorted({*REQUIRED, "bar_index"} - set(bars.columns)):
        raise ValueError(f"bars lack {', '.join(missing)}")


def true(c: Column) -> Column:
    """A flag that is false where it is unknown."""
    return F.coalesce(c, F.lit(False))


def momentum(b: pd.DataFrame, n: int) -> np.ndarray:
    """The regression, at the present bar, of the close's distance to the middle of range and mean."""
    high, low, close = (b[c].to_numpy(dtype=float) for c in ("high", "low", "close"))
    away = close - ((s.most(high, n) + -s.most(-low, n)) / 2 + s.means(close, n)) / 2
    return s.regressed(away, b[s.ORDER].to_numpy(dtype=float), n)


def squeezed(mean: np.ndarray, dev: np.ndarray, middle: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the band is within the channel, around it, or known and neither."""
    low, high, inner, outer = mean - dev, mean + dev, middle - width, middle + width
    on, off = (low > inner) & (high < outer), (low < inner) & (high > outer)
    return on, off, ~np.isnan(dev) & ~np.isnan(width) & ~on & ~off


#: Colours by the number that _color gives.
COLORS = np.array([None, "lime", "green", "red", "maroon"], dtype=object)


def _color(val: np.ndarray, last: np.ndarray) -> np.ndarray:
    """lime and green above zero, red and maroon at or below it; the first of each is that of a move away from zero."""
    known = ~np.isnan(val) & ~np.isnan(last)
    return COLORS[np.select([~known, val > 0], [0, np.where(val > last, 1, 2)], np.where(val < last, 3, 4))]


SQUEEZE_COLUMNS = {
    **dict.fromkeys(("true_range", "basis", "dev", "kc_ma", "rangema", "atr_norm", "upper_bb", "lower_bb", "upper_kc", "lower_kc"), "double"),
    **dict.fromkeys(("sqz_on", "sqz_off", "no_sqz"), "boolean"),
    **{"val": "double", "val_norm": "double", "val_rising": "boolean", "color_state": "string", "released": "boolean", "became_blue": "boolean"},
}


def squeeze_lines(b: pd.DataFrame, p: SqueezeParams, colors: bool = True) -> dict[str, np.ndarray]:
    """Channels, states, momentum and (colors) its colour for ordered bars of one series; unknown values are NaN."""
    close, reach = b["close"].to_numpy(dtype=float), s.true_ranges(b)
    width = reach if p.use_true_range else b["high"].to_numpy(dtype=float) - b["low"].to_numpy(dtype=float)
    basis, dev = s.means(close, p.bb_length), s.deviations(close, p.bb_length) * p.bb_mult
    middle, rangema, atr = s.means(close, p.kc_length), s.means(width, p.kc_length), s.means(width, p.atr_length)
    on, off, neither = squeezed(basis, dev, middle, rangema * p.kc_mult)
    val = momentum(b, p.momentum_length)
    last, was_on = s.before(val), np.concatenate([[False], on[:-1]])
    with np.errstate(divide="ignore", invalid="ignore"):
        norm = np.where(atr == 0, np.nan, val / atr)
    out = {"true_range": reach, "basis": basis, "dev": dev, "kc_ma": middle, "rangema": rangema, "atr_norm": atr}
    out |= {"upper_bb": basis + dev, "lower_bb": basis - dev, "upper_kc": middle + rangema * p.kc_mult, "lower_kc": middle - rangema * p.kc_mult}
    out |= {"sqz_on": on, "sqz_off": off, "no_sqz": neither, "val": val, "val_norm": norm, "val_rising": val > last}
    out |= {"color_state": _color(val, last)} if colors else {}
    return out | {"released": off & was_on, "became_blue": neither & was_on}


def _squeeze_reach(prefix: str = "") -> Column:
    """With the default parameters: the bars that windows look back on, and those of a run."""
    run = F.greatest(F.col(f"{prefix}squeeze_run"), F.col(f"{prefix}squeeze_run_before") + 1)
    return run + SqueezeParams().lookback + 1


@reaching(_squeeze_reach)
@lined(lambda b: squeeze_lines(b, SqueezeParams()), SQUEEZE_COLUMNS, SqueezeParams().lookback, {"sqz_on": "squeeze_run"})
def squeeze(bars: DataFrame, params: SqueezeParams | None = None, chunk_bars: int = s.CHUNK_BARS, runs: bool = True) -> DataFrame:
    """Channels, states, momentum and its colour, and (runs) the length of the running squeeze, which needs whole series."""
    p = params or SqueezeParams()
    check_columns(bars)
    return s.recursive(bars, lambda b: squeeze_lines(b, p), SQUEEZE_COLUMNS, p.lookback, chunk_bars, {"sqz_on": "squeeze_run"} if runs else None)


def _crossed(over: pd.Series) -> pd.Series:
    """Where a difference becomes positive from zero or less."""
    return (over > 0) & (over.shift(1) <= 0)


def wavetrend_lines(b: pd.DataFrame, p: WaveTrendParams) -> pd.DataFrame:
    """The lines and their crosses for ordered bars of one series."""
    out = pd.DataFrame({"hlc3": (b["high"] + b["low"] + b["close"]) / 3.0})
    out["esa"] = s.ema(out["hlc3"], p.channel_length)
    away = out["hlc3"] - out["esa"]
    out["d"] = s.ema(away.abs(), p.channel_length)
    out["ci"] = away / (0.015 * out["d"]).mask(out["d"] == 0)
    out["wt1"] = s.ema(out["ci"], p.average_length)
    last = pd.concat([out["wt1"].shift(k) for k in range(p.signal_length)], axis=1)
    out["wt2"] = last.sum(axis=1, skipna=False) / p.signal_length
    gap = out["wt1"] - out["wt2"]
    return out.assign(cross_up=_crossed(gap), cross_down=_crossed(-gap), oversold_zone=out["wt1"] < p.oversold, overbought_zone=out["wt1"] > p.overbought)


def wavetrend_lookback(p: WaveTrendParams) -> int:
    return 2 * s.memory(2 / (p.channel_length + 1)) + s.memory(2 / (p.average_length + 1)) + p.signal_length + 1


WAVETREND_COLUMNS = {**dict.fromkeys(("hlc3", "esa", "d", "ci", "wt1", "wt2"), "double"), **dict.fromkeys(("cross_up", "cross_down", "oversold_zone", "overbought_zone"), "boolean")}


@reaching(wavetrend_lookback(WaveTrendParams()))
@lined(lambda b: wavetrend_lines(b, WaveTrendParams()), WAVETREND_COLUMNS, wavetrend_lookback(WaveTrendParams()))
def wavetrend(bars: DataFrame, params: WaveTrendParams | None = None, chunk_bars: int = s.CHUNK_BARS) -> DataFrame:
    """Two exponentially smoothed lines of the typical price's channel index, their crosses and zones."""
    p = params or WaveTrendParams()
    check_columns(bars)
    return s.recursive(bars, lambda b: wavetrend_lines(b, p), WAVETREND_COLUMNS, wavetrend_lookback(p), chunk_bars)


def adx_lines(b: pd.DataFrame, p: AdxParams) -> pd.DataFrame:
    """Movement, its index and the crossings of both thresholds for ordered bars of one series."""
    high, low, last = (b[c].to_numpy(dtype=float) for c in ("high", "low", "close"))
    last = np.concatenate([[np.nan], last[:-1]])
    # steps of the highs upwards and of the lows downwards: the larger one counts, where it is one
    steps = np.stack([np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)], axis=1)
    moved = np.where((steps > steps[:, ::-1]) & (steps > 0), steps, 0.0)
    # the largest known one of the three: fmax passes over unknown prices, as the first bar's close before it
    reach = np.fmax(np.fmax(high - low, np.abs(high - last)), np.abs(low - last))
    sums = pd.DataFrame({"true_range": reach, "plus_dm": moved[:, 0], "minus_dm": moved[:, 1]}, index=b.index)
    smooth = sums.apply(s.wilder, n=p.length)
    share = 100.0 * smooth[["plus_dm", "minus_dm"]].div(smooth["true_range"].mask(smooth["true_range"] == 0), axis=0)
    total = share["plus_dm"] + share["minus_dm"]
    out = sums.assign(plus_di=share["plus_dm"], minus_di=share["minus_dm"])
    out["dx"] = 100.0 * (out["plus_di"] - out["minus_di"]).abs() / total.mask(total == 0)
    out["adx"] = s.wilder(out["dx"].fillna(0.0), p.length)
    return out.assign(cross_threshold=_crossed(out["adx"] - p.threshold), cross_secondary=_crossed(out["adx"] - p.secondary), bullish=out["plus_di"] > out["minus_di"])


def adx_lookback(p: AdxParams) -> int:
    return 2 * s.memory(1 / p.length) + 2


ADX_COLUMNS = {**dict.fromkeys(("true_range", "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx"), "double"), **dict.fromkeys(("cross_threshold", "cross_secondary", "bullish"), "boolean")}


@reaching(adx_lookback(AdxParams()))
@lined(lambda b: adx_lines(b, AdxParams()), ADX_COLUMNS, adx_lookback(AdxParams()))
def adx(bars: DataFrame, params: AdxParams | None = None, chunk_bars: int = s.CHUNK_BARS) -> DataFrame:
    """Directional movement by Wilder's smoothing: an unknown index (no movement at all) is smoothed as 0."""
    p = params or AdxParams()
    check_columns(bars)
    return s.recursive(bars.drop("true_range"), lambda b: adx_lines(b, p), ADX_COLUMNS, adx_lookback(p), chunk_bars)


def zero_divisions(lines: DataFrame, column: str) -> DataFrame:
    """How many bars of each series divide by zero: those where the smoothed range or deviation is 0."""
    return lines.groupBy("symbol", "interval").agg(F.count_if(F.col(column) == 0).alias("zero_division_bars"))


def smoothed(bars: DataFrame, alpha: float, column: str, out: str, chunk_bars: int = s.CHUNK_BARS) -> DataFrame:
    """One recursively smoothed price column, exact over series of any length and nulls of any number, without Python workers."""
    n = scan.chunk_for([alpha], chunk_bars)
    at = [*s.keys(bars), s.ORDER]
    df = scan.smoothed(scan.laid(bars.select(*at, F.col(column).alias("_of")), n, 0), {out: F.col("_of")}, alpha, n)
    return bars.join(scan.own(df, n).drop("_of"), at)


#: families of the grid: their indicator functions
FAMILIES = {"adx": adx, "wavetrend": wavetrend, "squeeze": squeeze}


def indicator(family: str):
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    return FAMILIES[family]
