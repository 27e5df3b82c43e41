"""Bars from tables of prices: by rows, by days and by fixed time steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions.shared import kept


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, nulls among them."""
    right = right.withColumnsRenamed({k: f"{k}_met" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_met")) for k in keys]).drop(*[f"{k}_met" for k in keys])


def numbered(rows: DataFrame, series: str | list[str], order: list[str], pieces: list[str], out: str = "rn") -> DataFrame:
    """rows with their number from 0 within their series, with no task that holds a series.

    Pieces cut a series in its order: among rows equal in the pieces before it,
    a piece does not fall along the order. Rows are numbered within the last
    piece, after the count of rows in the pieces before; counts are summed level
    by level, so that a window holds the parts of one piece. Nulls come first.
    """
    series = [series] if isinstance(series, str) else list(series)
    names = [f"_piece{k}" for k in range(len(pieces))]
    rows = rows.withColumns({n: F.expr(p) for n, p in zip(names, pieces, strict=True)})
    level = rows.groupBy(*series, *names).agg(F.count("*").alias("_n"))
    starts = None
    for k in reversed(range(len(names))):
        above = [*series, *names[:k]]
        earlier = Window.partitionBy(*above).orderBy(names[k]).rowsBetween(Window.unboundedPreceding, -1)
        before = level.select(*above, names[k], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(f"_before{k}"))
        starts = before if starts is None else _met(starts, before, [*above, names[k]])
        level = level.groupBy(*above).agg(F.sum("_n").alias("_n"))
    start = sum((F.col(f"_before{k}") for k in range(len(names))), F.lit(0))
    # the starts are written first, so that Spark knows how few they are and moves the rows once
    starts = kept(starts.select(*series, *names, start.alias("_start")), "starts")
    place = F.row_number().over(Window.partitionBy(*series, *names).orderBy(*order))
    rows = _met(rows.withColumn("_place", place), starts, [*series, *names])
    return rows.withColumn(out, (F.col("_start") + F.col("_place") - 1).cast("long")).drop(*names, "_start", "_place")


def row_bars(ticks: DataFrame, symbol: str, order: list[str], price: str, volume: str, time: str, rows: int, pieces: list[str] | None = None) -> DataFrame:
    """Bars of a fixed number of consecutive rows, which pieces cut for counting; an incomplete last bar is left out."""
    counted = numbered(ticks, symbol, order, pieces or order[:1])
    ticks = counted.select(F.col(symbol).alias("symbol"), F.col("rn"), F.col(price).alias("price"), F.col(volume).alias("qty"), F.col(time).alias("time"))
    bars = ticks.groupBy("symbol", F.expr(f"rn div {rows}").alias("bar_index")).agg(*_ohlc(F.col("rn")), F.sum("qty").alias("volume"), F.max("time").alias("close_time"), F.count("*").alias("count"))
    return bars.where(F.col("count") == rows).select("symbol", F.lit(f"{rows}r").alias("interval"), "bar_index", "open", "high", "low", "close", "volume", "close_time", "count")


def _ohlc(key: Column) -> list[Column]:
    return [F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close")]


#: Time steps of a piece that bars are numbered in.
PIECE_STEPS = 1 << 16


def time_bars(ticks: DataFrame, symbol: str, time: str, price: str, volume: str, key: list[str], minutes: int, name: str) -> DataFrame:
    """Bars of fixed time steps from the epoch; empty steps have no bar, so bar_index has no gaps but times may."""
    step = minutes * 60
    begin = F.timestamp_seconds(F.expr(f"unix_seconds(cast(`{time}` as timestamp)) div {step} * {step}"))
    rows = ticks.select(F.col(symbol).alias("symbol"), begin.alias("open_time"), F.col(price).alias("price"), F.col(volume).alias("qty"), F.struct(*key).alias("k"))
    bars = rows.groupBy("symbol", "open_time").agg(*_ohlc(F.col("k")), F.sum("qty").alias("volume"), F.count("*").alias("count"))
    bars = numbered(bars, "symbol", ["open_time"], [f"unix_seconds(open_time) div {step * PIECE_STEPS}"], "bar_index")
    close = F.col("open_time") + F.expr(f"make_dt_interval(0, 0, {minutes}, 0)") - F.expr("make_dt_interval(0, 0, 0, 0.001)")
    return bars.select("symbol", F.lit(name).alias("interval"), "bar_index", "open_time", close.alias("close_time"), "open", "high", "low", "close", "volume", "count")


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
#: A day's orders in stretches of about a million keys.
LINE_PIECES = ["l_shipdate", "l_orderkey div 1048576"]


def lineitem_bars(spark: SparkSession, sf_dir: str, rows: int = 2) -> DataFrame:
    """The main bar table: consecutive line items of a return flag."""
    return row_bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", LINE_ORDER, "l_extendedprice", "l_quantity", "l_shipdate", rows, LINE_PIECES)


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity", LINE_ORDER[1:], 1440, "1d")


def event_bars(spark: SparkSession, sf_dir: str, minutes: int = 240, name: str = "4h") -> DataFrame:
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("one", F.lit(1.0))
    return time_bars(ticks, "event_type", "ts", "value", "one", ["ts", "event_id"], minutes, name)
