"""Monthly zip-CSV kline archives: scan, checks and load."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions.shared import kept
from tidebar.operators import integrity
from tidebar.params import INTERVAL_MINUTES
from tidebar.sources.bars import numbered

#: Columns of the raw files, in their order; the first nine are kept. Fixed values.
RAW_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore")
KEPT = RAW_COLUMNS[:9]
#: Epochs above this are microseconds.
MICROSECONDS_FROM = 100_000_000_000_000


def month_range(start: datetime, end: datetime) -> list[str]:
    """Months that [start, end) touches; an end on the first of a month leaves that month out."""
    month, out = start.replace(day=1, hour=0, minute=0, second=0, microsecond=0), []
    while month < end:
        out.append(f"{month:%Y-%m}")
        month = (month + timedelta(days=32)).replace(day=1)
    return out


def step_minutes(interval: str) -> int:
    if interval not in INTERVAL_MINUTES:
        raise ValueError(f"unknown interval {interval}; known: {', '.join(INTERVAL_MINUTES)}")
    return INTERVAL_MINUTES[interval]


def archive_paths(root: str, symbols: list[str], intervals: list[str], start: datetime, end: datetime) -> list[str]:
    """root/SYMBOL-INTERVAL-YYYY-MM.zip of all series and months: only these files are read."""
    return [f"{root}/{s}-{i}-{m}.zip" for s in symbols for i in intervals for m in month_range(start, end)]


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of the archives' first members as strings, one task for some files; a file is unzipped in the task that reads it."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                symbol, interval = path.rsplit("/", 1)[-1].split("-")[:2]
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
                    reader = pd.read_csv(member, header=None, dtype=str, names=RAW_COLUMNS, usecols=range(9), chunksize=50_000, keep_default_na=False, encoding_errors="replace")
                    for part in reader:
                        part.insert(0, "interval", interval)
                        part.insert(0, "symbol", symbol)
                        yield part

    schema = "symbol string, interval string, " + ", ".join(f"`{c}` string" for c in KEPT)
    return files.mapInPandas(unzip, schema)


def parsed(raw: DataFrame) -> DataFrame:
    """Typed rows: header rows (any that begin like open_time) go, epochs are milli- or microseconds, bad numbers raise."""
    rows = raw.where(~F.lower(F.trim("open_time")).startswith("open_time"))
    when = lambda c: F.when(F.col(c).cast("long") > MICROSECONDS_FROM, F.timestamp_micros(F.col(c).cast("long"))).otherwise(F.timestamp_millis(F.col(c).cast("long"))).alias(c)
    number = lambda c: F.col(c).cast("double").alias(c)
    return rows.select("symbol", "interval", when("open_time"), *map(number, KEPT[1:6]), when("close_time"), number("quote_volume"), F.col("count").cast("long").alias("count"))


#: Seconds of a piece that bars are numbered in.
PIECE_SECONDS = 1 << 22


@dataclass(frozen=True)
class Panel:
    bars: DataFrame
    report: DataFrame


def load_panel(spark: SparkSession, root: str, symbols: list[str], intervals: list[str], start: datetime, end: datetime) -> Panel:
    """Bars of all series in [start, end) without repeated times, numbered from 0, and the report on what is missing."""
    for interval in intervals:
        step_minutes(interval)
    return _panel(parsed(read_archives(spark, archive_paths(root, symbols, intervals, start, end))), intervals, start, end)


def load_source(spark: SparkSession, root: str, symbols: list[str], intervals: list[str], start: datetime, end: datetime, **options: str | None) -> Panel:
    """As load_panel, by the source "klines": archives are fetched, cached and tried again by the tasks that read them.

    The rows are written once to the shared folder, as bars and report read them
    several times and at once: each archive is fetched once, with a cache or without.
    """
    from tidebar.sources import archive

    archive.register(spark)
    given = {"root": root, "symbols": ",".join(symbols), "intervals": ",".join(intervals), "start": start.isoformat(), "end": end.isoformat(), **options}
    rows = spark.read.format("klines").options(**{k: v for k, v in given.items() if v}).load()
    return _panel(kept(rows, "klines"), intervals, start, end)


def _panel(rows: DataFrame, intervals: list[str], start: datetime, end: datetime) -> Panel:
    rows = rows.where((F.col("open_time") >= F.lit(start)) & (F.col("open_time") < F.lit(end)))
    first = Window.partitionBy("symbol", "interval", "open_time").orderBy("close_time", "open", "high", "low", "close", "volume")
    unique = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    bars = numbered(unique, ["symbol", "interval"], ["open_time"], [f"unix_seconds(open_time) div {PIECE_SECONDS}"], "bar_index")
    return Panel(bars, integrity.report(rows, {i: step_minutes(i) for i in intervals}, start, end))


def load_klines(spark: SparkSession, root: str, symbol: str, interval: str, start: datetime, end: datetime) -> Panel:
    return load_panel(spark, root, [symbol], [interval], start, end)
