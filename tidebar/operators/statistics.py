"""Grouped statistics of returns: moments and tests in the plan, p-values on small results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions import distributions as d
from tidebar.functions import resample, selection
from tidebar.functions.shared import kept
from tidebar.params import BOOTSTRAP_ROUNDS, COSTS_BPS, MIN_SAMPLE

#: Indexes of a chunk of a series that is thinned.
CHUNK = 1 << 16


def t_statistic(x: Column) -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, std, median, stderr, t_stat and win_rate of the non-null values."""
    n, mean = F.col("n"), F.col("mean")
    std = F.sqrt(F.col("m2") / F.nullif(n - 1, F.lit(0)))
    found = selection.described(selection.valued(df, by, F.col(value)), by)
    return found.select(*by, n, mean, std.alias("std"), "median", (std / F.sqrt(n)).alias("stderr"), F.try_divide(mean, std / F.sqrt(n)).alias("t_stat"), (F.col("wins") / n).alias("win_rate"))


def with_p_value(summed: DataFrame) -> DataFrame:
    return summed.withColumn("p_value", d.t_p_value(F.col("t_stat"), F.col("n") - 1))


def welch(df: DataFrame, by: list[str], side: Column, value: str) -> DataFrame:
    """Two-sample t without equal variances: side true against false."""
    x = F.col(value)
    a, b = F.when(side, x), F.when(~side, x)
    out = df.where(x.isNotNull()).groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    sa, sb = F.col("_va") / F.col("n_a"), F.col("_vb") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb))
    df_ = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    enough = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    return out.select(*by, "n_a", "n_b", "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("difference"), F.when(enough, t).alias("t_stat"), F.when(enough, df_).alias("dof"))


def brown_forsythe(df: DataFrame, by: list[str], side: Column, value: str) -> DataFrame:
    """Equality of spread about the medians of side true and false: statistic, ratio of deviations, ratio of median moves."""
    cell = [*by, "_side"]
    values = selection.valued(df.withColumn("_side", side), cell, F.col(value))
    absolute = values.withColumn("_x", F.abs("_x"))
    moves = selection.described(absolute, cell).select(*cell, F.col("median").alias("_a"))
    middle = kept(selection.described(values, cell).select(*cell, F.col("n").alias("_n"), F.col("median").alias("_m"), F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0))).alias("_s")), "cells")
    z = F.abs(F.col("_x") - F.col("_m"))
    far = selection.met(values, middle, cell).groupBy(*cell).agg(F.max("_n").alias("_n"), F.max("_s").alias("_s"), F.sum(F.col("_c") * z).alias("_z"), F.sum(F.col("_c") * z * z).alias("_q"))
    mean = F.col("_z") / F.col("_n")
    far = far.withColumns({"_mean": mean, "_var": F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))})
    parts = selection.met(far, moves, cell)
    pick = lambda c, s: F.max(F.when(F.col("_side") == s, F.col(c)))
    wide = parts.groupBy(*by).agg(*[pick(c, s).alias(f"{c}{int(s)}") for c in ("_n", "_mean", "_var", "_s", "_a") for s in (True, False)])
    n1, n0, m1, m0 = (F.col(c) for c in ("_n1", "_n0", "_mean1", "_mean0"))
    grand = (n1 * m1 + n0 * m0) / (n1 + n0)
    between = n1 * (m1 - grand) * (m1 - grand) + n0 * (m0 - grand) * (m0 - grand)
    within = n1 * F.col("_var1") + n0 * F.col("_var0")
    stat = F.try_divide((n1 + n0 - 2) * between, within)
    return wide.select(*by, n1.alias("n_events"), n0.alias("n_baseline"), stat.alias("statistic"), F.try_divide(F.col("_s1"), F.col("_s0")).alias("std_ratio"), F.try_divide(F.col("_a1"), F.col("_a0")).alias("median_abs_ratio"))


def average_rank(value: Column, by: list[str], descending: bool = False) -> Column:
    """Rank with ties averaged; nulls have none."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    tied = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order)) + (tied - 1) / 2)


def percentile_rank(value: Column, by: list[str]) -> Column:
    """Average rank over the number of non-null values."""
    return average_rank(value, by) / F.count(value).over(Window.partitionBy(*by))


def signs_agree(mean: Column, require: int | None = None) -> Column:
    """Aggregate: all groups' means have one sign (0 is one of its own), and there are as many groups as required."""
    one = F.count_distinct(F.signum(mean)) == 1
    return F.coalesce(one & (F.count(mean) == require) if require else one, F.lit(False))


def _next_kept(places: np.ndarray, far: int) -> np.ndarray:
    """For each row, in order of places, the one that is kept after it if it is kept itself; their number where there is none."""
    return np.searchsorted(places, places + far)


def _exits(places: np.ndarray, far: int, begin: int, length: int) -> np.ndarray:
    """Where the chunk after this one is free, by where this one is free: both counted from their chunk's begin, from 0 to far - 1."""
    n = len(places)
    jump, last = np.append(_next_kept(places, far), n), np.arange(n + 1)
    # the last row kept after each one, by doubling the steps
    while (jump < n).any():
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    first = np.searchsorted(places, begin + np.arange(far))
    ends = np.append(places, begin + length - far)[last[first]] + far - (begin + length)
    return np.maximum(ends, 0)


def _kept(places: np.ndarray, far: int, free: int) -> np.ndarray:
    """Which rows a greedy thinning keeps that is free from a place on."""
    keep, after = np.zeros(len(places), dtype=bool), _next_kept(places, far).tolist()
    at = int(np.searchsorted(places, free))
    while at < len(places):
        keep[at] = True
        at = after[at]
    return keep


def non_overlapping(df: DataFrame, by: list[str], horizon: str = "horizon", index: str = "bar_index") -> DataFrame:
    """The rows of a greedy thinning in order of index: each at least horizon + 1 after the last one kept.

    A series is cut into chunks of CHUNK indexes, or of horizon + 1 where that is
    more. What a chunk does to the rest is a function of few values: how far into
    it the last row kept before still reaches, to how far the last one kept in it
    reaches into the next. Chunks give their functions, which are composed along
    the series (one short row a chunk), and then each chunk is thinned on its own:
    a series with a row at every index is spread over as many tasks as any other.
    """
    names = df.columns
    key = [*by, horizon]
    length = F.greatest(F.lit(CHUNK), F.col(horizon) + 1)
    rows = df.withColumn("_chunk", F.floor(F.col(index) / length).cast("long"))
    group = [*key, "_chunk"]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in group)

    def functions(pdf: pd.DataFrame) -> pd.DataFrame:
        far, chunk = int(pdf[horizon].iloc[0]) + 1, int(pdf["_chunk"].iloc[0])
        size = max(CHUNK_LENGTH, far)
        exits = _exits(np.sort(pdf[index].to_numpy(dtype=np.int64)), far, chunk * size, size)
        return pdf[group].head(1).assign(_exits=[exits.tolist()])

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        entries, free, due = [], 0, None
        for chunk, exits in zip(pdf["_chunk"], pdf["_exits"], strict=True):
            entries.append(free := free if chunk == due else 0)
            free, due = int(exits[free]), chunk + 1
        return pdf[group].assign(_free=entries)

    def thinned(part: pa.Table, entry: pa.Table) -> pa.Table:
        if not part.num_rows:
            return part.select(names)
        far, chunk = part[horizon][0].as_py() + 1, part["_chunk"][0].as_py()
        part = part.sort_by(index)
        free = chunk * max(CHUNK_LENGTH, far) + entry["_free"][0].as_py()
        return part.select(names).filter(pa.array(_kept(part[index].to_numpy().astype(np.int64), far, free)))

    CHUNK_LENGTH = CHUNK  # noqa: N806  (as it is when the plan is made)
    made = rows.select(*group, index).groupBy(*group).applyInPandas(functions, f"{schema}, _exits array<int>")
    entries = made.groupBy(*key).applyInPandas(along, f"{schema}, _free int")
    return rows.groupBy(*group).cogroup(entries.groupBy(*group)).applyInArrow(thinned, df.schema)


def bootstrap(df: DataFrame, by: list[str], value: str, order: list[str], method: str = "blocks", min_n: int = MIN_SAMPLE) -> DataFrame:
    """n, mean, ci_low, ci_high of each cell; the interval is null below min_n values or two blocks. method: blocks (whole ones) or moving (filled up to n values)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    return bootstraps(df, by, value, order, min_n).where(F.col("method") == method).drop("method")


METHODS = ("blocks", "moving")


def bootstraps(df: DataFrame, by: list[str], value: str, order: list[str], min_n: int = MIN_SAMPLE) -> DataFrame:
    """by, method, n, mean, ci_low, ci_high: both methods from the same draws."""
    values, sizes = resample.sample(df, by, value, order)
    cells = sizes.select(*by, "n", (F.col("total") / F.col("n")).alias("mean"), F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"))
    means = resample.rounds(values, sizes.where(F.col("n") >= min_n), by)
    tall = means.selectExpr(*[f"`{c}`" for c in by], "stack(2, 'blocks', blocks, 'moving', moving) as (method, mean)")
    ends = resample.interval(tall, [*by, "method"], F.col("mean"))
    return selection.met(cells, ends, [*by, "method"], "left").select(*by, "method", "n", "mean", "ci_low", "ci_high")


#: Fewest values of either side of a difference that has an interval.
SIDE_SAMPLE = 20


def bootstrap_difference(df: DataFrame, by: list[str], side: str, value: str, order: list[str]) -> DataFrame:
    """n_a, n_b, ci_low, ci_high of the difference of means of side true and false, each resampled in blocks with draws of its own; null where a side has fewer than SIDE_SAMPLE values."""
    both = [*by, side]
    values, sizes = resample.sample(df.where(F.col(side).isNotNull()), both, value, order)
    size = lambda on: F.sum(F.when(F.col(side) == on, F.col("n")).otherwise(0))
    cells = sizes.groupBy(*by).agg(size(True).alias("n_a"), size(False).alias("n_b"))
    means = resample.rounds(values, sizes.where(F.col("n") >= SIDE_SAMPLE), both, F.when(F.col(side), 0).otherwise(BOOTSTRAP_ROUNDS))
    pick = lambda on: F.max(F.when(F.col(side) == on, F.col("blocks")))
    apart = means.groupBy(*by, "round").agg((pick(True) - pick(False)).alias("_d")).where(F.col("_d").isNotNull())
    return selection.met(cells, resample.interval(apart, by, F.col("_d")), by, "left").select(*by, "n_a", "n_b", "ci_low", "ci_high")


def cost_matrix(cells: DataFrame, low: str, costs=COSTS_BPS) -> DataFrame:
    """For each cell, whether its lower bound is above each cost."""
    return cells.withColumns({f"above_{str(c).replace('.', '_')}": F.coalesce(F.col(low) > c, F.lit(False)) for c in costs})
