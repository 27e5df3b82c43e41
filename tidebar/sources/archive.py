"""Monthly kline archives as a Spark source: spark.read.format("klines"), with one partition for each archive.

Options: root (a folder or http(s) address of archives; needed), symbols,
intervals (comma-separated), start, end (dates; months that [start, end) touches),
layout (where an archive lies under root), cache (a folder that executors share;
unset: none), tries, timeout (seconds). Rows are typed: an epoch is in milli- or
microseconds, a header row goes, a bad number raises.

Filters on symbol, interval, open_time and close_time prune archives before any
is fetched; Spark applies them to the rows as well. An archive that can't be had
in so many tries, after waits of 1, 2, 4, .. seconds, fails the read: months are
never left out silently. Lost executors cost the fetches of their partitions,
and not those that the cache has.
"""

from __future__ import annotations

import os
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidebar.sources.klines import MICROSECONDS_FROM, month_range, step_minutes

#: Address and layout of the public archive of futures' klines. Fixed values.
PUBLIC_ROOT = "https://data.binance.vision/data/futures/um/monthly/klines"
PUBLIC_LAYOUT = "{symbol}/{interval}/{symbol}-{interval}-{month}.zip"
FLAT_LAYOUT = "{symbol}-{interval}-{month}.zip"
TRIES, TIMEOUT = 4, 120
SCHEMA = "symbol string, interval string, open_time timestamp, open double, high double, low double, close double, volume double, close_time timestamp, quote_volume double, count long"


@dataclass(frozen=True)
class Archive(InputPartition):
    symbol: str
    interval: str
    month: str


def opened(url: str, timeout: float) -> bytes:
    if "://" not in url:
        with open(url, "rb") as f:
            return f.read()
    with urllib.request.urlopen(url, timeout=timeout) as response:
        return response.read()


def fetched(url: str, cache: str | None, name: str, tries: int = TRIES, timeout: float = TIMEOUT, get: Callable[[str, float], bytes] = opened, wait: Callable[[float], None] = time.sleep) -> bytes:
    """An archive's bytes, from the cache where it has them (an empty file counts as none).

    A file enters the cache whole, under its name by a rename, so that tasks that
    fetch it at once, or die while they do, leave none cut short.
    """
    place = os.path.join(cache, name) if cache else None
    if place and os.path.exists(place) and os.path.getsize(place):
        return opened(place, timeout)
    for attempt in range(tries):
        try:
            content = get(url, timeout)
            break
        except Exception as e:
            if attempt + 1 == tries:
                raise RuntimeError(f"{url} not fetched in {tries} tries") from e
            wait(2.0**attempt)
    if place:
        os.makedirs(cache, exist_ok=True)
        part = f"{place}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, place)
    return content


def bounds(month: str) -> tuple[datetime, datetime]:
    first = datetime.strptime(month, "%Y-%m").replace(tzinfo=UTC)
    return first, (first + timedelta(days=32)).replace(day=1)


def keeps(f: Filter, a: Archive) -> bool:
    """Whether an archive may hold a row that passes f."""
    name = f.attribute[0] if len(f.attribute) == 1 else None
    if name in ("symbol", "interval"):
        mine = getattr(a, name)
        return mine == f.value if isinstance(f, EqualTo) else mine in f.value if isinstance(f, In) else True
    if name not in ("open_time", "close_time"):
        return True
    first, after = bounds(a.month)
    if name == "close_time":  # a month's last bar may close at the next one's beginning
        after += timedelta(minutes=step_minutes(a.interval))
    utc = lambda t: t.astimezone(UTC)
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return utc(f.value) <= after
    if isinstance(f, (LessThan, LessThanOrEqual)):
        return utc(f.value) >= first
    if isinstance(f, EqualTo):
        return first <= utc(f.value) <= after
    return True


def _time(text: str) -> datetime:
    n = int(text)
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=n if n > MICROSECONDS_FROM else n * 1000)


def rows(content: bytes, symbol: str, interval: str) -> Iterator[tuple]:
    """Typed rows of an archive's first member, a line at a time."""
    import csv
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
        for line in csv.reader(io.TextIOWrapper(member, "utf-8", errors="replace")):
            if line and not line[0].strip().lower().startswith("open_time"):
                yield (symbol, interval, _time(line[0]), *map(float, line[1:6]), _time(line[6]), float(line[7]), int(line[8]))


class KlineReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        missing = [k for k in ("root", "symbols", "intervals", "start", "end") if not options.get(k)]
        if missing:
            raise ValueError(f"klines need the options {', '.join(missing)}")
        self.root, self.cache = options["root"].rstrip("/"), options.get("cache")
        self.layout = options.get("layout") or FLAT_LAYOUT
        self.tries, self.timeout = int(options.get("tries") or TRIES), float(options.get("timeout") or TIMEOUT)
        names = lambda k: [x.strip() for x in options[k].split(",") if x.strip()]
        for interval in names("intervals"):
            step_minutes(interval)
        self.start, self.end = (datetime.fromisoformat(options[k]).replace(tzinfo=UTC) for k in ("start", "end"))
        self.archives = [Archive(x, i, m) for x in names("symbols") for i in names("intervals") for m in month_range(self.start, self.end)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.archives = [a for a in self.archives if keeps(f, a)]
        return filters

    def partitions(self) -> list[InputPartition]:
        return self.archives

    def read(self, partition: Archive | None) -> Iterator[tuple]:
        if partition is None:  # no archive is left
            return
        fill = {"symbol": partition.symbol, "interval": partition.interval, "month": partition.month}
        content = fetched(f"{self.root}/{self.layout.format(**fill)}", self.cache, FLAT_LAYOUT.format(**fill), self.tries, self.timeout)
        yield from (r for r in rows(content, partition.symbol, partition.interval) if self.start <= r[2] < self.end)


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KlineReader:
        return KlineReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("klines") known to a session, and lets its filters prune archives."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KlineSource)
