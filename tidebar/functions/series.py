"""Ordered-series building blocks: one partition and order spec for every window.

A series is (symbol, interval) and, where a long series is cut, (.., chunk):
chunks carry the bars before them that windows look back on, so that any number
of tasks can share one series and every window stays in one chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidebar.functions.shared import kept

SERIES = ("symbol", "interval")
ORDER = "bar_index"
#: Bars of one chunk; a window's task holds this many and the look-back.
CHUNK_BARS = 1 << 17


def keys(df: DataFrame) -> list[str]:
    """The columns that make a series in df: also the grid's or the checker's own, where they are there."""
    return [c for c in (*SERIES, "setting_key", "cut", "chunk") if c in df.columns]


def over(df: DataFrame) -> Window:
    return Window.partitionBy(*keys(df)).orderBy(ORDER)


def last(df: DataFrame, n: int) -> Window:
    """The frame of n bars up to the present one."""
    return over(df).rowsBetween(-(n - 1), 0)


def full(df: DataFrame, c: Column, n: int, f: Callable[[Column], Column]) -> Column:
    """f over the last n bars, null unless all n values are there."""
    w = last(df, n)
    return F.when(F.count(c).over(w) == n, f(c).over(w))


#: Bars of a part of a long mean: a frame costs its length at each bar, the sums of parts are looked up.
PART, LONG = 10, 50


def sma(df: DataFrame, c: Column, n: int) -> Column:
    if n < LONG or n % PART:
        return full(df, c, n, F.avg)
    part = full(df, c, PART, F.sum)
    return sum((F.lag(part, k).over(over(df)) for k in range(PART, n, PART)), part) / n


def population_std(df: DataFrame, c: Column, n: int) -> Column:
    return full(df, c, n, F.stddev_pop)


def rolling_linreg(df: DataFrame, c: Column, n: int) -> Column:
    """Least squares over the last n bars, at the present bar."""
    w = last(df, n)
    at = F.col(ORDER).cast("double")
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w) + F.regr_slope(c, at).over(w) * ((n - 1) / 2))


def true_range(df: DataFrame) -> Column:
    """greatest() passes over nulls, so the first bar's is high - low."""
    before = F.lag("close", 1).over(over(df))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def crosses_up(a: Column, b: Column, w: Window) -> Column:
    return F.coalesce((a > b) & (F.lag(a, 1).over(w) <= F.lag(b, 1).over(w)), F.lit(False))


def crosses_down(a: Column, b: Column, w: Window) -> Column:
    return F.coalesce((a < b) & (F.lag(a, 1).over(w) >= F.lag(b, 1).over(w)), F.lit(False))


def spread(bars: DataFrame, lookback: int, lookahead: int = 0, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """bars with chunk and own: each bar in its own chunk, and as a neighbour in those whose windows reach it. Bars that a caller has spread, far enough for all that it does with them, stay as they are."""
    if "own" in bars.columns:
        return bars
    first = F.greatest(F.lit(0), F.expr(f"({ORDER} - {lookahead}) div {chunk_bars}"))
    final = F.expr(f"({ORDER} + {lookback}) div {chunk_bars}")
    out = bars.withColumn("chunk", F.explode(F.sequence(first, final)))
    return out.withColumn("own", F.col("chunk") == F.expr(f"{ORDER} div {chunk_bars}"))


def gathered(df: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Only the bars that their chunk owns; all where it was given bars that a caller had spread."""
    return df if bars is not None and "own" in bars.columns else df.where("own").drop("own", "chunk")


def run_length(df: DataFrame, flag: str, out: str, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Consecutive true flags up to the present bar, and (out_before) up to the one before, for df without chunks.

    Within a chunk: the distance to the last false bar. Across chunks: the last
    false bar of those before, of which there is one row a chunk.
    """
    series = keys(df)
    part = df.withColumn("_chunk", F.expr(f"{ORDER} div {chunk_bars}"))
    false_at = F.when(~F.col(flag), F.col(ORDER))
    chunks = part.groupBy(*series, "_chunk").agg(F.max(false_at).alias("_last"))
    before = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*series, "_chunk", F.max("_last").over(before).alias("_carry"))
    within = Window.partitionBy(*series, "_chunk").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({"_mine": F.max(false_at).over(within), "_then": F.max(false_at).over(earlier)}).join(carried, [*series, "_chunk"])
    run = lambda mine, shift: (F.col(ORDER) - shift - F.coalesce(mine, "_carry", F.lit(-1))).cast("int")
    return part.withColumns({out: run("_mine", 0), f"{out}_before": run("_then", 1)}).drop("_chunk", "_mine", "_then", "_carry")


# Recursive smoothing: y = y' + alpha (x - y'), from the first value on. Nulls
# leave y and let its weight decay, as in exponentially weighted means that
# count absolute positions.


def _ewm(x: pd.Series, alpha: float) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False).mean()


def ema(x: pd.Series, n: int) -> pd.Series:
    return _ewm(x, 2 / (n + 1))


def wilder(x: pd.Series, n: int) -> pd.Series:
    return _ewm(x, 1 / n)


def memory(alpha: float, left: float = 1e-18) -> int:
    """Bars after which a start value weighs less than left."""
    import math

    return int(math.log(left) / math.log1p(-alpha)) + 1 if alpha < 1 else 1


# Frames within a task: the values of all frames are added from the oldest to the
# present one, as Spark's window frames do, so that both give the same doubles.
# Unknown values are NaN, and so is a frame that holds one or isn't full.


def _padded(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(n - len(x), np.nan), x])


def _shifted(x: np.ndarray, n: int) -> list[np.ndarray]:
    """Of all full frames of n: the oldest values, .., the present ones."""
    full_ones = max(0, len(x) - n + 1)
    return [x[k : k + full_ones] for k in range(n)]


def sums(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(x) - n + 1))
    for v in _shifted(x, n):
        out += v
    return _padded(out, len(x))


def means(x: np.ndarray, n: int) -> np.ndarray:
    """sma in arrays."""
    if n < LONG or n % PART:
        return sums(x, n) / n
    part = sums(x, PART)
    out = part.copy()
    for k in range(PART, n, PART):
        out += before(part, k)
    return out / n


def before(x: np.ndarray, k: int = 1) -> np.ndarray:
    return _padded(x[: max(0, len(x) - k)], len(x))


def most(x: np.ndarray, n: int) -> np.ndarray:
    return _padded(np.maximum.reduce(_shifted(x, n)), len(x))


def deviations(x: np.ndarray, n: int) -> np.ndarray:
    """population_std in arrays."""
    mean, squares = np.zeros(max(0, len(x) - n + 1)), np.zeros(max(0, len(x) - n + 1))
    for k, v in enumerate(_shifted(x, n)):
        away = v - mean
        step = away / (k + 1)
        mean += step
        squares += away * (away - step)
    return _padded(np.sqrt(squares / n), len(x))


def regressed(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """rolling_linreg in arrays; at: places of the values."""
    size = max(0, len(x) - n + 1)
    place, value, together, spread_ = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)
    for k, (a, v) in enumerate(zip(_shifted(at, n), _shifted(x, n), strict=True)):
        away = a - place
        step = away / (k + 1)
        place += step
        value += (v - value) / (k + 1)
        together += away * (v - value)
        spread_ += away * (away - step)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(spread_ == 0, np.nan, together / spread_)
    return sums(x, n) / n + _padded(slope, len(x)) * ((n - 1) / 2)


def true_ranges(b: pd.DataFrame) -> np.ndarray:
    """true_range in arrays: fmax passes over unknown prices."""
    high, low, last_close = b["high"].to_numpy(dtype=float), b["low"].to_numpy(dtype=float), before(b["close"].to_numpy(dtype=float))
    return np.fmax(np.fmax(high - low, np.abs(high - last_close)), np.abs(low - last_close))


_TYPES = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}


def ordered(part: pa.Table) -> pa.Table:
    """A chunk's rows by their bars; windows leave them so."""
    at = part[ORDER].to_numpy()
    return part if (at[1:] >= at[:-1]).all() else part.take(pa.array(np.argsort(at, kind="stable")))


def prices(part: pa.Table) -> pd.DataFrame:
    return part.select([c for c in (ORDER, "open", "high", "low", "close") if c in part.column_names]).to_pandas()


def recursive(bars: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], columns: dict[str, str], lookback: int, chunk_bars: int = CHUNK_BARS, runs: dict[str, str] | None = None) -> DataFrame:
    """bars with a kernel's columns (name to type); the kernel gets the prices of a chunk's ordered bars and returns its columns, which the task puts beside the bars, so that bars and columns don't meet in a join.

    A chunk that doesn't begin its series starts lookback bars early; what the
    start value still weighs then is below the rounding of a double. Bars that a
    caller has spread stay spread. Where bars have a column wanted, the kernel
    sees all of them, and those wanted alone leave the task.

    runs: flags (of columns) and the names of their run lengths, up to the present
    bar and (_before) up to the one before, for bars that aren't spread. A task
    gives the last false bar of its chunk, and one row a chunk carries it on.
    """
    parts = spread(bars, lookback, 0, chunk_bars)
    carried, whole, some, runs = bars.columns, "own" in bars.columns, "wanted" in bars.columns, runs or {}
    if whole and runs:
        raise ValueError("run lengths need bars that aren't spread")
    marks = {**{f"{x}{out}": "long" for out in runs.values() for x in ("_mine_", "_then_")}, "_end": "boolean"} if runs else {}
    fields = [f for f in parts.schema if f.name in carried or runs and f.name == "chunk"]
    schema = T.StructType(fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in (columns | marks).items()])

    def run(part: pa.Table) -> pa.Table:
        part = ordered(part)
        made, own = kernel(prices(part)), part["own"].to_numpy()
        made = {n: np.asarray(made[n]) for n in columns}
        keep = np.ones(len(own), dtype=bool) if whole else own
        if some:
            keep = keep & part["wanted"].to_numpy()
        if runs:
            at, end = part[ORDER].to_numpy(), np.zeros(len(own), dtype=bool)
            end[np.flatnonzero(own)[-1:]] = True
            for flag, out in runs.items():
                mine = np.maximum.accumulate(np.where(own & ~made[flag], at, -1))
                made |= {f"_mine_{out}": mine, f"_then_{out}": np.concatenate([[-1], mine[:-1]])}
            made["_end"], keep = end, keep | end
        rows = np.flatnonzero(keep)
        out = part.select([f.name for f in fields]).take(pa.array(rows))
        for n, t in (columns | marks).items():
            out = out.append_column(n, pa.array(made[n][rows], _TYPES[t], from_pandas=True))  # no NaN may reach the engine
        return out

    df = parts.groupBy(*keys(parts)).applyInArrow(run, schema)
    return _runs(df, list(runs.values()), some) if runs else df


def _runs(df: DataFrame, names: list[str], some: bool) -> DataFrame:
    """Run lengths of bars that have the last false bars of their chunk (-1 where it has none). The few that are wanted are written, so that their tasks run once."""
    df = kept(df, "lines") if some else df
    at = keys(df)
    before = Window.partitionBy(*at[:-1]).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.where("_end").select(*at, *[F.max(f"_mine_{n}").over(before).alias(f"_carry_{n}") for n in names])
    length = lambda n, x, shift: (F.col(ORDER) - shift - F.greatest(f"{x}{n}", F.coalesce(f"_carry_{n}", F.lit(-1)))).cast("int")
    out = (df.where("wanted") if some else df).join(carried, at)
    out = out.withColumns({f"{n}{end}": length(n, x, shift) for n in names for end, x, shift in (("", "_mine_", 0), ("_before", "_then_", 1))})
    return out.drop("chunk", "_end", *[f"{x}{n}" for n in names for x in ("_mine_", "_then_", "_carry_")])
