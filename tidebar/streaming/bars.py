"""Streaming: bars from ticks, and causal indicators kept by series across batches.

Every indicator here depends on the past alone, so the streaming results are
those of the batch over the same bars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars_from_ticks(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """symbol, open_time, open, high, low, close, volume, count of ticks (symbol, time, price, qty); a bar comes when it is final."""
    window = F.window("time", f"{minutes} minutes")
    grouped = ticks.withWatermark("time", late).groupBy("symbol", window.alias("w"))
    key = F.struct("time", "price")
    bars = grouped.agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("count"))
    return bars.select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "count")


def smoothed(bars: DataFrame, alpha: float, column: str = "close") -> DataFrame:
    """symbol, bar_index, value of streamed bars, which come in order within a series: the state is one number a series."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("bar_index", kind="stable")
        out = []
        for x in rows[column].tolist():
            last = x if last is None else (1 - alpha) * last + alpha * x
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({"symbol": key[0], "bar_index": rows["bar_index"].to_numpy(), "value": out})

    return bars.groupBy("symbol").applyInPandasWithState(update, "symbol string, bar_index bigint, value double", "last double", "append", GroupStateTimeout.NoTimeout)
