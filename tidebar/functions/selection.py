"""Moments and exact medians of all cells at once, with no task that holds a cell's values.

Values are written, as they are read three times. First cells are histograms of
a few bins an octave, which tasks count before anything travels: they give the
mean and the bins of the middle ranks. Then the deviations from that mean are
summed, and the values of those bins are counted by their leading FINE bits, which
keep the order. Last the values of the one or two middle fine bins are ranked. So
what travels is bounded by bins, not by values, and a window holds a cell's bins,
or the distinct values of a fine bin, which agree in all but 2^-FINE of their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions.shared import kept

#: Mantissa bits of the bins that ranks are counted in.
BITS = 16
#: Bins of an octave in a first histogram, and mantissa bits of the bins within the middle ones.
COARSE, FINE = 128, 24


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls among them."""
    right = right.withColumnsRenamed({k: f"_met_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_met_{k}")) for k in keys], F.lit(True))
    return left.join(right, same, how).drop(*[f"_met_{k}" for k in keys])


def leading(x: Column, bits: int = BITS) -> Column:
    """x towards zero at so many bits after its first: never falls as x rises. Values below the normal doubles may count as 0."""
    size = F.abs(x)
    about = F.pow(F.lit(2.0), F.least(F.floor(F.log2(size)), F.lit(1023)))
    octave = F.when(about > size, about / 2).when(about * 2 <= size, about * 2).otherwise(about)  # the logarithm may round across a power
    cut = F.signum(x) * F.floor(size / octave * (1 << bits)) * (octave / (1 << bits))
    return F.when((size > 0) & (size < float("inf")), cut).otherwise(x)


def counted(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """by, _x, _c: each cell's distinct non-null values and how often they are there."""
    return df.where(x.isNotNull()).groupBy(*by, x.cast("double").alias("_x")).agg(F.count("*").alias("_c"))


def valued(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """by, _x, _c: each cell's non-null values, once each."""
    return kept(df.where(x.isNotNull()).select(*by, x.cast("double").alias("_x")), "values").withColumn("_c", F.lit(1).cast("long"))


def coarse(x: Column) -> Column:
    """The number of x's bin among COARSE an octave: never falls as x rises."""
    size = F.abs(x)
    # below 2^1024 the logarithm is above -1075: numbers stay positive, and the sign is theirs
    number = F.floor(F.log2(size) * COARSE).cast("long") + 1080 * COARSE
    return F.when(size == 0, 0).when(size < float("inf"), F.when(x < 0, -number).otherwise(number)).otherwise(F.when(x < 0, -2_000_000 * COARSE).otherwise(2_000_000 * COARSE)).cast("long")


def described(values: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean, m2 (squared deviations from the mean), wins (values above 0) and median of valued or counted values."""
    names = [f"`{c}`" for c in by]
    cell = ", ".join(names) or "1"
    binned = values.select(*by, "_x", "_c", coarse(F.col("_x")).alias("_bin"))
    bins = binned.groupBy(*by, "_bin").agg(F.sum("_c").alias("_n"), F.expr("sum(_c * _x)").alias("_s"), F.expr("sum(if(_x > 0, _c, 0))").alias("_w"))
    placed = bins.selectExpr(*names, "_bin", "_n", "_s", "_w", f"sum(_n) over (partition by {cell} order by _bin) - _n as _before", f"sum(_n) over (partition by {cell}) as _total")
    holds = lambda bin_, rank: f"max(if(_before <= {rank} and _before + _n > {rank}, struct({bin_}, _before), null))"
    low, high = "(_total - 1) div 2", "_total div 2"
    found = placed.groupBy(*by).agg(*[F.expr(x) for x in ("max(_total) as _total", "sum(_s) / max(_total) as _about", "sum(_w) as _wins", f"{holds('_bin', low)} as _a", f"{holds('_bin', high)}._bin as _b")])
    # no value lies between the two middle bins, so that their fine bins are counted on from the lower one's start
    # cells are written, so that Spark knows how few they are and leaves the values where they are
    found = kept(found.selectExpr(*names, "_total", "_about", "_wins", "_a._bin as _a", "_a._before as _start", "_b"), "cells")
    near = met(binned, found, by)
    inner = F.when((F.col("_bin") == F.col("_a")) | (F.col("_bin") == F.col("_b")), leading(F.col("_x"), FINE))
    same = ["_total", "_about", "_wins", "_start"]
    sums = near.withColumn("_fine", inner).groupBy(*by, *same, "_fine").agg(F.sum("_c").alias("_n"), F.expr("sum(_c * (_x - _about))").alias("_d"), F.expr("sum(_c * (_x - _about) * (_x - _about))").alias("_q"))
    ranked = sums.selectExpr(*names, *same, "_fine", "_n", "_d", "_q", f"if(_fine is null, null, _start + sum(if(_fine is null, 0, _n)) over (partition by {cell} order by _fine) - _n) as _before")
    moments = ["max(_total) as n", "max(_about) + sum(_d) / max(_total) as mean", "greatest(sum(_q) - sum(_d) * sum(_d) / max(_total), 0D) as m2", "max(_wins) as wins", f"{holds('_fine', low)} as _a", f"{holds('_fine', high)}._fine as _b"]
    middle = kept(ranked.groupBy(*by).agg(*[F.expr(x) for x in moments]).selectExpr(*names, "n", "mean", "m2", "wins", "_a._fine as _a", "_a._before as _start", "_b"), "cells")
    # the values of the one or two fine bins that the middle ranks fall in, ranked within them; others are told by their size
    size = F.abs("_x")
    about = (size >= F.least(F.abs("_a"), F.abs("_b"))) & (size <= F.greatest(F.abs("_a"), F.abs("_b")) * (1 + 2.0 ** (1 - FINE)) + 1e-300)
    fine = leading(F.col("_x"), FINE)
    near = met(values.select(*by, "_x", "_c"), middle, by).where(about).where((fine == F.col("_a")) | (fine == F.col("_b")))
    same = ["n", "mean", "m2", "wins", "_start"]
    near = near.groupBy(*by, *same, "_x").agg(F.sum("_c").alias("_c"))
    at = near.selectExpr(*names, *same, "_x", "_c", f"_start + sum(_c) over (partition by {cell} order by _x) - _c as _at")
    taken = lambda rank: f"max(if(_at <= {rank} and _at + _c > {rank}, _x, null)) * 0.5D"
    return at.groupBy(*by).agg(*[F.expr(f"max({c}) as {c}") for c in same[:-1]], F.expr(f"{taken('(n - 1) div 2')} + {taken('n div 2')}").alias("median"))


def medians(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """by, n, median of the non-null values of x."""
    return described(valued(df, by, x), by).select(*by, "n", "median")


def average_ranks(df: DataFrame, by: list[str], value: str, out: str, of: str, descending: bool = False) -> DataFrame:
    """df with out, the rank of value in its cell (ties share their average), and of, how many the cell has; a null has no rank.

    Ranks are counted: the bins before a value's own, the values before it in its
    bin, and half of those equal to it. A row finds its rank by its value.
    """
    values = counted(df, by, F.col(value)).withColumn("_bin", leading(F.col("_x")))
    bins = values.groupBy(*by, "_bin").agg(F.sum("_c").alias("_n"))
    bins = bins.select(*by, "_bin", _ranks(by, "_bin", "_n").alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias(of))
    placed = met(values, bins, [*by, "_bin"])
    rank = F.col("_before") + _ranks([*by, "_bin"], "_x", "_c") + (F.col("_c") + 1) / 2
    found = placed.select(*by, F.col("_x").alias(value), (F.col(of) + 1 - rank if descending else rank).alias(out), of)
    return met(df, found, [*by, value], "left")


def _ranks(cell: list[str], order: str, n: str) -> Column:
    """How many are before, in order, in the same cell."""
    return F.sum(n).over(Window.partitionBy(*cell).orderBy(order)) - F.col(n)
