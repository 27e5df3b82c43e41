"""Command line: load archives of klines, report on what is missing, and write the bars where asked.

python -m tidebar.sources.fetch --symbols BTCUSDT ETHUSDT --intervals 1h --start 2025-01-01 --end 2025-03-01 --cache /shared/klines --out /shared/bars
"""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from tidebar.sources import archive, klines


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Load monthly archives of klines.")
    p.add_argument("--symbols", nargs="+", default=["BTCUSDT", "ETHUSDT", "SOLUSDT"])
    p.add_argument("--intervals", nargs="+", default=["5m", "15m", "1h"])
    p.add_argument("--start", default="2025-01-01")
    p.add_argument("--end", default="2026-06-01")
    p.add_argument("--root", default=archive.PUBLIC_ROOT)
    p.add_argument("--layout", default=archive.PUBLIC_LAYOUT)
    p.add_argument("--cache", help="a folder that all executors share")
    p.add_argument("--out", help="where the bars go, as Parquet by symbol and interval")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> klines.Panel:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("klines").getOrCreate()
    panel = klines.load_source(spark, a.root, a.symbols, a.intervals, datetime.fromisoformat(a.start), datetime.fromisoformat(a.end), layout=a.layout, cache=a.cache)
    if a.out:
        panel.bars.write.mode("overwrite").partitionBy("symbol", "interval").parquet(a.out)
    panel.report.orderBy("symbol", "interval").show(truncate=False)
    return panel


if __name__ == "__main__":
    main()
