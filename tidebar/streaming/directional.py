"""Directional movement of streamed bars, which may come in any order: typed state of each series, by transformWithStateInPandas.

The state is the smoothed lines after the last bar handled and the bars that came
before their turn. Bars are numbered without gaps from 0 (as all bars here are),
so a bar waits until those before it are there, and results are those of
indicators.adx over the same bars. A bar that comes again is ignored. The session
needs the RocksDB state store, which such states are kept in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebar.params import AdxParams

BAR = "high double, low double, close double"
LINES = "next bigint, high double, low double, close double, true_range double, plus double, minus double, adx double"
OUT = "symbol string, bar_index bigint, plus_di double, minus_di double, adx double"


def stepped(lines: tuple | None, bar: tuple, length: int) -> tuple:
    """The lines after one more bar (high, low, close)."""
    high, low, close = bar
    if lines is None:
        n, reach, plus, minus = 0, high - low, 0.0, 0.0
    else:
        n, last_high, last_low, last = lines[:4]
        reach = max(high - low, abs(high - last), abs(low - last))
        up, down = high - last_high, last_low - low
        plus, minus = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
    mixed = lambda old, x: x if lines is None else old + (x - old) / length
    old = (None,) * 4 if lines is None else lines[4:]
    sums = [mixed(o, x) for o, x in zip(old[:3], (reach, plus, minus), strict=True)]
    total = sums[1] + sums[2]
    dx = 100.0 * abs(sums[1] - sums[2]) / total if total and sums[0] else 0.0
    return (n + 1, high, low, close, *sums, mixed(old[3], dx))


class Movement(StatefulProcessor):
    def __init__(self, length: int) -> None:
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getValueState("lines", LINES)
        self.early = handle.getMapState("early", "bar_index bigint", BAR)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        lines = self.lines.get() if self.lines.exists() else None
        turn = int(lines[0]) if lines else 0
        for part in rows:
            for n, *bar in part[["bar_index", "high", "low", "close"]].itertuples(index=False, name=None):
                if n >= turn and not self.early.containsKey((int(n),)):
                    self.early.updateValue((int(n),), tuple(map(float, bar)))
        out = []
        while self.early.containsKey((turn,)):
            lines = stepped(lines and tuple(lines), tuple(self.early.getValue((turn,))), self.length)
            self.early.removeKey((turn,))
            share = [100.0 * x / lines[4] if lines[4] else None for x in lines[5:7]]
            out.append((key[0], turn, *share, lines[7]))
            turn += 1
        if out:
            self.lines.update(lines)
            yield pd.DataFrame(out, columns=["symbol", "bar_index", "plus_di", "minus_di", "adx"])

    def close(self) -> None:
        pass


def adx(bars: DataFrame, params: AdxParams | None = None) -> DataFrame:
    """symbol, bar_index, plus_di, minus_di, adx of streamed bars (symbol, bar_index, high, low, close), each once those before it are there."""
    p = params or AdxParams()
    rows = bars.select("symbol", "bar_index", "high", "low", "close")
    return rows.groupBy("symbol").transformWithStateInPandas(Movement(p.length), OUT, "Append", "None")
