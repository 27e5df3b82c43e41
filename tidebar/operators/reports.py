"""Report tables over cells and events: slices by period, pass counts, pivots, comparisons and lists.

All of them read results (cells, settings) or one pass over events; none needs
more than a grouped aggregation, and edges, labels and tests are literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions import distributions as d
from tidebar.operators import statistics as st

GROUPS = ("S1", "S2", "S3")


def period_of(time: Column, edges: list[str]) -> Column:
    """The number, from 0, of the half-open period [edge, next edge) that a time is in; null outside of all."""
    bounds = [F.lit(e).cast("timestamp") for e in edges]
    return F.coalesce(*[F.when((time >= a) & (time < b), k) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])


#: Days of one bin that periods and times are joined by.
PERIOD_DAYS = 64


def in_periods(rows: DataFrame, periods: DataFrame, time: str, days: int = PERIOD_DAYS) -> DataFrame:
    """rows with the other columns of periods (begin, end, ..), once for each half-open period [begin, end) that the time is in: periods of any number that may overlap.

    A join of ranges: a period is in every bin of days that it touches, a row in
    its time's bin, and rows of one bin meet that bin's periods only. Null times
    and empty periods meet nothing.
    """
    bin_of = lambda t: f"floor(unix_micros(cast({t} as timestamp)) / {days * 86_400_000_000}D)"
    wide = periods.where(F.col("end") > F.col("begin")).withColumn("_bin", F.expr(f"explode(sequence({bin_of('begin')}, {bin_of('end')}))"))
    met = rows.withColumn("_bin", F.expr(bin_of(f"`{time}`"))).join(wide, "_bin")
    return met.where((F.col(time) >= F.col("begin")) & (F.col(time) < F.col("end"))).drop("_bin", "begin", "end")


def passing(cells: DataFrame, **tests: Column) -> DataFrame:
    """cells with each test as a flag, false where it is unknown, and passes: all of them."""
    flags = {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}
    return cells.withColumns({**flags, "passes": reduce(Column.__and__, flags.values())})


def pass_counts(judged: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """How many cells hold each flag, and whether any and all pass."""
    counted = [F.count_if(f).alias(f"n_{f}") for f in (*flags, "passes")]
    return judged.groupBy(*by).agg(F.count("*").alias("cells"), *counted, F.bool_or("passes").alias("any_passes"), F.bool_and("passes").alias("all_pass"))


def pivoted(df: DataFrame, rows: list[str], column: str, names: dict, value: Column) -> DataFrame:
    """One row per `rows` and one column per key of names (a value of `column`, and what its column is called): value, an aggregate."""
    wide = df.groupBy(*rows).pivot(column, list(names)).agg(value)
    return wide.select(*rows, *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def three_way(rows: DataFrame, by: list[str], value: str = "signed_atr", group: str = "group") -> DataFrame:
    """Sizes and moments of the three groups in one row, and Welch's test of the first against the last."""
    x = F.col(value)
    each = []
    for g in GROUPS:
        mine = F.when(F.col(group) == g, x)
        each += [F.count(mine).alias(f"n_{g}"), F.avg(mine).alias(f"mean_{g}"), F.stddev_samp(mine).alias(f"std_{g}")]
    wide = rows.where(x.isNotNull()).groupBy(*by).agg(*each)
    tested = st.welch(rows.where(F.col(group).isin(GROUPS[0], GROUPS[-1])), by, F.col(group) == GROUPS[0], value)
    tested = tested.select(*by, "difference", "t_stat", "dof", d.t_p_value(F.col("t_stat"), F.col("dof")).alias("p_value"))
    return wide.join(tested, by, "left")


def same_results(a: DataFrame, b: DataFrame, by: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """One row: cells of either table, cells of one alone, and whether all columns agree (two nulls do)."""
    x = a.select(*by, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    y = b.select(*by, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    agree = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) | F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.lit(False)) for c in columns]
    same = ~alone & reduce(Column.__and__, agree)
    return x.join(y, by, "full_outer").agg(F.count("*").alias("cells"), F.count_if(alone).alias("unmatched"), F.coalesce(F.bool_and(same), F.lit(True)).alias("identical"))


def selection_lists(breakdown: DataFrame, passed: int = 20, dropped: int = 15) -> DataFrame:
    """The best settings that pass, and the best of those that don't: list, place and the cell. The limits are the report's."""
    order = [F.col("score").asc_nulls_last(), "setting_key", "interval"]
    best = lambda name, rows, n: rows.orderBy(*order).limit(n).withColumn("list", F.lit(name))
    both = best("passed", breakdown.where("passes_all"), passed).unionByName(best("dropped", breakdown.where("not passes_all"), dropped))
    from pyspark.sql.window import Window

    return both.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy(*order)))
