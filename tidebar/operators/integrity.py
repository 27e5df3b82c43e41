"""Completeness of bar series: expected against actual times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRETCH = 10_000
#: Seconds, and bars, of a series that are looked at in one go.
SPAN_SECONDS, SPAN_BARS = 1 << 20, 1 << 16


def require_complete(found: DataFrame) -> None:
    """Ends the job where a series of the report lacks bars; the message names the first few."""
    bad = found.where("not complete").orderBy("symbol", "interval").limit(5).collect()
    if bad:
        raise SystemExit("incomplete series: " + "; ".join(f"{r['symbol']} {r['interval']}: {r['actual_bars']} of {r['expected_bars']} bars" for r in bad))


def missing_times(bars: DataFrame, minutes: int, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """symbol, open_time of the steps in [start, end) (or from a series' first to its last bar) without a bar."""
    step = F.expr(f"make_dt_interval(0, 0, {minutes}, 0)")
    span = bars.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    a, b = (F.lit(start) if start else F.col("a")), (F.lit(end) - step if end else F.col("b"))
    # by stretches of STRETCH steps, so that no row holds a whole series' times
    stretch = F.expr(f"make_dt_interval(0, 0, {minutes * STRETCH}, 0)")
    parts = span.select("symbol", b.alias("b"), F.explode(F.sequence(a, b, stretch)).alias("a"))
    upto = F.least(F.col("b"), F.col("a") + F.expr(f"make_dt_interval(0, 0, {minutes * (STRETCH - 1)}, 0)"))
    expected = parts.select("symbol", F.explode(F.sequence(F.col("a"), upto, step)).alias("open_time"))
    return expected.join(bars.select("symbol", "open_time").distinct(), ["symbol", "open_time"], "left_anti")


def report(bars: DataFrame, minutes: dict[str, int], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Per series: expected and actual bars, repeated times, missing bars, irregular steps, completeness."""
    series = ["symbol", "interval"]
    step = F.coalesce(*[F.when(F.col("interval") == i, m * 60) for i, m in minutes.items()])
    seconds = F.unix_seconds("open_time")
    span = F.floor(seconds / SPAN_SECONDS)
    # steps within spans of a series, then those from one span to the next, so that no task sorts a series
    gap = seconds - F.lag(seconds, 1).over(Window.partitionBy(*series, "span").orderBy("open_time"))
    odd = lambda x: (x != 0) & (x != F.col("step"))
    rows = bars.select(*series, "open_time", step.alias("step"), span.alias("span")).withColumn("gap", gap)
    spans = rows.groupBy(*series, "step", "span").agg(
        F.count("*").alias("rows"),
        F.count_distinct("open_time").alias("actual_bars"),
        F.min("open_time").alias("a"),
        F.max("open_time").alias("b"),
        F.count_if(odd(F.col("gap"))).alias("odd"),
    )
    edge = F.unix_seconds("a") - F.lag(F.unix_seconds("b"), 1).over(Window.partitionBy(*series).orderBy("span"))
    found = spans.withColumn("edge", edge).groupBy(*series, "step").agg(
        F.sum("rows").alias("rows"),
        F.sum("actual_bars").alias("actual_bars"),
        F.min("a").alias("a"),
        F.max("b").alias("b"),
        (F.sum("odd") + F.count_if(odd(F.col("edge")))).alias("irregular_steps"),
    )
    a = F.unix_seconds(F.lit(start)) if start else F.unix_seconds("a")
    b = F.unix_seconds(F.lit(end)) if end else F.unix_seconds("b") + F.col("step")
    expected = ((b - a) / F.col("step")).cast("long")
    return found.select(
        *series,
        expected.alias("expected_bars"),
        "actual_bars",
        (F.col("rows") - F.col("actual_bars")).alias("duplicated_times"),
        (expected - F.col("actual_bars")).alias("missing_bars"),
        "irregular_steps",
        (expected == F.col("actual_bars")).alias("complete"),
    )


def missing_pattern(missing: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent times of day and days of month of missing bars, with their share and whether that is a concentration."""
    kinds = missing.select(F.explode(F.array(F.struct(F.lit("time").alias("kind"), F.date_format("open_time", "HH:mm:ss").alias("value")), F.struct(F.lit("day").alias("kind"), F.date_format("open_time", "dd").alias("value")))).alias("k"))
    counted = kinds.groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    # each missing bar has one value of each kind
    total = F.sum("n").over(Window.partitionBy("kind"))
    share = F.col("n") / F.col("total")
    return counted.withColumns({"place": rank, "total": total}).where(F.col("place") <= top).select("kind", "value", "n", "place", F.round(share, 6).alias("share"), ((share > 0.3) & (F.col("total") >= 10)).alias("concentrated"))


def spacing_faults(bars: DataFrame, minutes: int) -> DataFrame:
    """symbol, faults: steps between neighbouring bars that differ from the interval."""
    seconds, span = F.unix_seconds("open_time"), F.floor(F.col("bar_index") / SPAN_BARS)
    gap = F.col("seconds") - F.lag("seconds", 1).over(Window.partitionBy("symbol", "span").orderBy("bar_index"))
    rows = bars.select("symbol", "bar_index", seconds.alias("seconds"), span.alias("span")).withColumn("gap", gap)
    fault = lambda x: F.count_if(x != minutes * 60)
    spans = rows.groupBy("symbol", "span").agg(fault(F.col("gap")).alias("faults"), F.min_by("seconds", "bar_index").alias("a"), F.max_by("seconds", "bar_index").alias("b"))
    edge = F.col("a") - F.lag("b", 1).over(Window.partitionBy("symbol").orderBy("span"))
    return spans.withColumn("edge", edge).groupBy("symbol").agg((F.sum("faults") + fault(F.col("edge"))).alias("faults"))


def assert_contiguous(bars: DataFrame, minutes: int) -> None:
    """Raises where bars aren't equally spaced, and names the first few series."""
    if bad := spacing_faults(bars, minutes).where("faults > 0").orderBy("symbol").limit(5).collect():
        raise ValueError(f"bars aren't equally spaced: {', '.join(r['symbol'] for r in bad)}")
