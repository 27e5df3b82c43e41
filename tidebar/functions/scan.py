"""Recursive smoothing as a scan of affine maps, in the plan and exact whatever the length of a series.

A step y = A y' + b composes with others to one of its kind, so a chunk of a
series is one map. Within a chunk, with P the product of the A up to a bar and S
the sum of b / P, y = P (S + z), where z is y at the chunk's first value. Chunks
are so short that P stays a normal double. Their maps, one row each, are composed
along the series by doubling, until what is left out weighs less than a double's
rounding, and each chunk is given its z. No chunk looks back on bars of another
for its smoothing, and nulls, however many, take nothing away.

Nulls leave y and let its weight decay, as in exponentially weighted means that
count absolute positions: after a gap of g bars A = q^g / (q^g + alpha). NaN
counts as null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions import series as s

#: Binary digits that the product of a chunk may fall by, and those beyond which a start value counts for nothing.
RANGE, LOST = 800, 64
#: The least decay of a step: alpha = 1 keeps the last value, to the last digit.
LEAST = 2.0**-60


def _decay(alpha: float) -> float:
    return max(1.0 - alpha, LEAST)


def chunk_for(alphas: list[float], chunk_bars: int = s.CHUNK_BARS) -> int:
    """Bars of a chunk in which smoothing by each alpha keeps to RANGE."""
    return max(1, min(chunk_bars, *(int(RANGE / -math.log2(_decay(a))) for a in alphas)))


def _doublings(alpha: float, chunk: int) -> int:
    """How often maps of chunks are composed: a value's weight falls least over a chunk at the worst spacing of values."""
    gap = np.arange(1, chunk + 1, dtype=float)
    old = _decay(alpha) ** gap
    with np.errstate(divide="ignore"):
        digits = float(np.min(np.log2((old + alpha) / old) / gap)) * chunk
    return max(1, math.ceil(math.log2(1 + LOST / digits)))


def _step(gap: Column, x: Column, alpha: float) -> tuple[Column, Column]:
    """A and b of a value that comes so many bars after the last one."""
    q = _decay(alpha)
    old = F.when(gap == 1, F.lit(q)).otherwise(F.pow(F.lit(q), gap))
    return old / (old + alpha), x * alpha / (old + alpha)


def laid(bars: DataFrame, chunk: int, back: int) -> DataFrame:
    """bars in chunks, with as many bars before a chunk's own as the windows over the smoothed lines look back on."""
    return s.spread(bars, back, 0, chunk).drop("own")


def own(df: DataFrame, chunk: int) -> DataFrame:
    """Only the bars that their chunk owns."""
    return df.where(F.expr(f"{s.ORDER} div {chunk}") == F.col("chunk")).drop("chunk")


def smoothed(df: DataFrame, columns: dict[str, Column], alpha: float, chunk: int, back: int = 0) -> DataFrame:
    """df (laid with chunk and back) with the smoothed columns: name to what is smoothed.

    A chunk's map is that of the bars up to those which the next chunk holds as
    well, so that maps follow on each other without overlap.
    """
    series = [c for c in s.keys(df) if c != "chunk"]
    order = s.over(df)
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.col(s.ORDER)
    kept = [*df.columns]
    col = lambda kind, n: F.col(f"_{kind}_{n}")
    df = df.withColumns({f"_x_{n}": F.when(~F.isnan(c), c) for n, c in columns.items()})
    there = {n: F.when(col("x", n).isNotNull(), at) for n in columns}
    df = df.withColumns({f"_gap_{n}": F.when(col("x", n).isNotNull(), at - F.max(there[n]).over(earlier)) for n in columns})
    steps = {n: _step(col("gap", n), col("x", n), alpha) for n in columns}
    df = df.withColumns({f"_p_{n}": F.coalesce(F.product(steps[n][0]).over(upto), F.lit(1.0)) for n in columns})
    df = df.withColumns({f"_s_{n}": F.coalesce(F.sum(steps[n][1] / col("p", n)).over(upto), F.lit(0.0)) for n in columns})

    counts = at + back < (F.col("chunk") + 1) * chunk
    of = []
    for n in columns:
        last = F.when(counts, at)
        of += [F.min(there[n]).alias(f"_first_{n}"), F.min_by(col("x", n), there[n]).alias(f"_start_{n}"), F.max(F.when(counts, there[n])).alias(f"_last_{n}")]
        of += [F.max_by(col("p", n), last).alias(f"_pe_{n}"), F.max_by(col("s", n), last).alias(f"_se_{n}")]
    maps = df.groupBy(*series, "chunk").agg(*of)
    chunks = Window.partitionBy(*series).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumns({f"_before_{n}": F.max(f"_last_{n}").over(chunks) for n in columns})
    for n in columns:
        a, b = _step(col("first", n) - col("before", n), col("start", n), alpha)
        new = col("before", n).isNull()
        maps = maps.withColumns({f"_a_{n}": F.when(new, 0.0).otherwise(a), f"_b_{n}": F.when(new, col("start", n)).otherwise(b), f"_has_{n}": col("last", n).isNotNull()})
        maps = maps.withColumns({f"_m_{n}": F.when(col("has", n), col("pe", n) * col("a", n)), f"_c_{n}": F.when(col("has", n), col("pe", n) * (col("se", n) + col("b", n)))})
        full = Window.partitionBy(*series, f"_has_{n}").orderBy("chunk")
        for k in range(_doublings(alpha, chunk)):
            ago = lambda kind: F.coalesce(F.lag(col(kind, n), 1 << k).over(full), F.lit(0.0))  # noqa: B023, E731
            maps = maps.withColumns({f"_c_{n}": col("c", n) + col("m", n) * ago("c"), f"_m_{n}": col("m", n) * ago("m")})
    maps = maps.withColumns({f"_y_{n}": F.last(f"_c_{n}", ignorenulls=True).over(chunks) for n in columns})
    given = [c for n in columns for c in (f"_first_{n}", f"_y_{n}")]
    starts = [(col("a", n) * F.coalesce(f"_y_{n}", F.lit(0.0)) + col("b", n)).alias(f"_z_{n}") for n in columns]
    df = df.join(maps.select(*series, "chunk", *given, *starts), [*series, "chunk"])
    lines = {n: F.when(at >= col("first", n), col("p", n) * (col("s", n) + col("z", n))).otherwise(col("y", n)) for n in columns}
    return df.select(*kept, *[c.alias(n) for n, c in lines.items()])
