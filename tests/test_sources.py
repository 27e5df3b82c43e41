"""Archives, integrity, sinks, candidates and streaming."""

import http.server
import random
import threading
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidebar.operators import grid, indicators, integrity
from tidebar.sources import archive as ar
from tidebar.sources import bars, fetch, klines, sinks
from tidebar.streaming import bars as streaming
from tidebar.streaming import directional

JAN, FEB = datetime(2025, 1, 1), datetime(2025, 2, 1)
HEAD = ",".join(klines.RAW_COLUMNS)


def row(i, unit=1000, price="10.5"):
    t = (int(JAN.timestamp()) + i * 3600) * unit
    return f"{t},{price},11,10,10.25,5,{t + 3600 * unit - 1},50,7,1,1,0"


def archive(path, lines):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.csv", "\n".join(lines) + "\n")
    return path


def test_months():
    assert klines.month_range(datetime(2024, 11, 15), FEB) == ["2024-11", "2024-12", "2025-01"]
    with pytest.raises(ValueError):
        klines.step_minutes("7m")


def test_archives_with_and_without_header_and_faults(spark, tmp_path):
    archive(tmp_path / "AAA-1h-2025-01.zip", [HEAD, row(0), row(2), row(1), row(1), row(5), row(24 * 31)])
    archive(tmp_path / "BBB-1h-2025-01.zip", [row(i, 1_000_000) for i in range(744)])
    panel = klines.load_panel(spark, str(tmp_path), ["AAA", "BBB"], ["1h"], JAN, FEB)
    got = panel.bars.where("symbol = 'AAA'").orderBy("bar_index").collect()
    assert [r.bar_index for r in got] == [0, 1, 2, 3] and got[0].open == 10.5
    report = {r.symbol: r for r in panel.report.collect()}
    assert (report["AAA"].duplicated_times, report["AAA"].missing_bars, report["AAA"].irregular_steps, report["AAA"].complete) == (1, 740, 1, False)
    assert report["BBB"].complete and report["BBB"].expected_bars == 744
    one = panel.bars.where("symbol = 'AAA'")
    assert integrity.missing_times(one, 60, JAN, FEB).count() == 740
    with pytest.raises(ValueError):
        integrity.assert_contiguous(one, 60)
    integrity.assert_contiguous(panel.bars.where("symbol = 'BBB'"), 60)


def test_bad_numbers_raise(spark, tmp_path):
    archive(tmp_path / "AAA-1h-2025-01.zip", [row(0, price="n/a")])
    with pytest.raises(Exception, match="CAST"):
        klines.load_klines(spark, str(tmp_path), "AAA", "1h", JAN, FEB).bars.collect()


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None)], "k string, n int, x double")
    sinks.write_csv(df, str(tmp_path / "t"))
    assert sorted(sinks.read_csv(spark, str(tmp_path / "t"), "k string, n int, x double").collect()) == sorted(df.collect())
    assert sinks.read_csv(spark, str(tmp_path / "none"), "k string", required=False).count() == 0
    assert sinks.markdown_table(df.orderBy("k"), decimals={"x": 1}).splitlines()[2:] == ["| a | 1 | 2.5 |", "| b | 2 | - |"]
    sinks.write_report(str(tmp_path / "r.md"), "T", {"One": "x"})
    assert (tmp_path / "r.md").read_text().startswith("# T")


def test_candidates_round_trip(tmp_path):
    found = [{"family": "adx", "params": {"length": 14, "threshold": 25.0}, "interval": "1h", "horizon": 3}]
    path = str(tmp_path / "c.json")
    grid.write_candidates(found, path)
    assert grid.read_candidates(path) == found and grid.setting_of(found[0], grid.build_grid()).key == "adx[length=14, threshold=25.0]"
    grid.write_candidates([], path)
    with pytest.raises(SystemExit):
        grid.read_candidates(path)


def test_streamed_bars_and_smoothing(spark, tmp_path):
    ticks = spark.createDataFrame([("A", JAN.replace(minute=m, second=s), float(m + s), 1.0) for m in range(50) for s in (0, 30)], "symbol string, time timestamp, price double, qty double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = streaming.bars_from_ticks(stream, 5).writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("bars_out").orderBy("open_time").collect()
    assert len(got) >= 7 and (got[0].open, got[0].high, got[0].close, got[0]["count"]) == (0.0, 34.0, 34.0, 10)
    bars = spark.createDataFrame([("A", i, float(i % 5)) for i in range(40)], "symbol string, bar_index long, close double")
    bars.coalesce(1).write.parquet(str(tmp_path / "bars"))
    s = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))
    q = streaming.smoothed(s, 0.5).writeStream.format("memory").queryName("ema_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    y = None
    for r in spark.table("ema_out").orderBy(F.col("bar_index")).collect():
        y = float(r.bar_index % 5) if y is None else 0.5 * y + 0.5 * (r.bar_index % 5)
        assert abs(r.value - y) < 1e-12


def test_numbers_by_pieces_are_row_numbers(spark):
    rows = [(k, "ab"[k % 7 == 0], None if k % 50 == 3 else k * 37 % 11, None if k % 40 == 5 else k * 101 % 997) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, s string, day int, n int").repartition(5, "k")
    got = bars.numbered(df, "s", ["day", "n", "k"], ["day", "n div 64"])
    assert got.columns == [*df.columns, "rn"]
    low = lambda x: -1 if x is None else x
    for name in "ab":
        want = sorted((low(d), low(n), k) for k, s, d, n in rows if s == name)
        assert [(low(r.day), low(r.n), r.k) for r in sorted(got.where(F.col("s") == name).collect(), key=lambda r: r.rn)] == want
        assert sorted(r.rn for r in got.where(F.col("s") == name).collect()) == list(range(len(want)))
    assert bars.numbered(df.limit(0), "s", ["k"], ["day"]).count() == 0


def test_source_of_archives_prunes_months_and_series(spark, tmp_path):
    """Only the archives that filters leave are there: any other would fail the read."""
    archive(tmp_path / "AAA-1h-2025-01.zip", [HEAD, row(0), row(2), row(1), row(1, 1_000_000), row(24 * 31)])
    archive(tmp_path / "BBB-1h-2025-01.zip", [row(i) for i in range(744)])
    ar.register(spark)
    options = {"root": str(tmp_path), "symbols": "AAA,BBB,CCC", "intervals": "1h", "start": "2024-11-01", "end": "2025-04-01"}
    df = spark.read.format("klines").options(**options).load()
    begin, end = F.lit("2025-01-01 02:00:00Z").cast("timestamp"), F.lit("2025-01-31 00:00:00Z").cast("timestamp")
    some = df.where(F.col("symbol").isin("AAA", "BBB") & (F.col("open_time") >= begin) & (F.col("open_time") < end))
    assert {(r.symbol, r["count"]) for r in some.groupBy("symbol").count().collect()} == {("AAA", 1), ("BBB", 718)}
    assert df.where("symbol = 'DDD'").count() == 0
    assert df.where((F.col("symbol") == "BBB") & (F.col("open_time") == begin)).count() == 1
    with pytest.raises(Exception, match="not fetched in 1 tries"):
        spark.read.format("klines").options(**options, tries="1").load().where("symbol = 'CCC'").count()
    with pytest.raises(Exception, match="options root"):
        spark.read.format("klines").load().count()
    panels = [f(spark, str(tmp_path), ["AAA", "BBB"], ["1h"], JAN, FEB) for f in (klines.load_panel, klines.load_source)]
    for part in ("bars", "report"):
        a, b = (sorted(map(str, getattr(p, part).collect())) for p in panels)
        assert a == b


def test_fetch_tries_four_times_and_keeps_whole_files(tmp_path):
    asked, waits = [], []

    def failing(url, timeout, until=9):
        asked.append(url)
        if len(asked) < until:
            raise OSError("busy")
        return b"content"

    with pytest.raises(RuntimeError, match="4 tries"):
        ar.fetched("u", str(tmp_path), "a.zip", get=failing, wait=waits.append)
    assert len(asked) == 4 and waits == [1, 2, 4] and not list(tmp_path.iterdir())
    asked.clear()
    (tmp_path / "a.zip").touch()
    assert ar.fetched("u", str(tmp_path), "a.zip", get=lambda u, t: failing(u, t, 3), wait=waits.append) == b"content"
    assert ar.fetched("u", str(tmp_path), "a.zip", get=None) == b"content" and [p.name for p in tmp_path.iterdir()] == ["a.zip"]


def test_command_line_over_a_failing_server(spark, tmp_path, capsys):
    """The first two answers are errors; the second run asks the server for nothing."""
    archive(tmp_path / "AAA-1h-2025-01.zip", [row(i) for i in range(744)])
    content, asked = (tmp_path / "AAA-1h-2025-01.zip").read_bytes(), []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            good = len(asked) > 2
            self.send_response(200 if good else 503)
            self.end_headers()
            self.wfile.write(content if good else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    args = ["--symbols", "AAA", "--intervals", "1h", "--start", "2025-01-01", "--end", "2025-02-01", "--root", f"http://127.0.0.1:{server.server_port}", "--cache", str(tmp_path / "cache"), "--out", str(tmp_path / "out")]
    fetch.main(args, spark)
    assert len(asked) == 3 and set(asked) == {"/AAA/1h/AAA-1h-2025-01.zip"} and "AAA" in capsys.readouterr().out
    server.shutdown()
    assert fetch.main(args, spark).bars.count() == 744 == spark.read.parquet(str(tmp_path / "out")).count()


def test_archives_that_may_hold_a_time():
    a = ar.Archive("A", "1h", "2025-01")
    at = lambda *x: datetime(*x, tzinfo=UTC)
    assert ar.bounds("2024-12") == (at(2024, 12, 1), at(2025, 1, 1))
    assert ar.keeps(ar.GreaterThan(("close_time",), at(2025, 2, 1, 0, 30)), a) and not ar.keeps(ar.GreaterThan(("open_time",), at(2025, 2, 1, 0, 30)), a)
    assert not ar.keeps(ar.LessThan(("open_time",), at(2024, 12, 31)), a) and ar.keeps(ar.LessThan(("volume",), 1.0), a)
    assert ar.keeps(ar.In(("symbol",), ("A", "B")), a) and not ar.keeps(ar.EqualTo(("interval",), "4h"), a)


def test_streamed_movement_of_shuffled_bars_is_that_of_the_batch(spark, tmp_path):
    """Bars in any order over three batches, some of them twice, one after a gap that is never filled."""
    draw = random.Random(4)
    at = [[draw.uniform(90, 110) for _ in range(3)] for _ in range(60)]
    rows = [(s, "1h", i, min(x), max(x), min(x), x[0]) for s in "AB" for i, x in enumerate(at[:: 1 if s == "A" else -1])]
    df = spark.createDataFrame(rows, "symbol string, interval string, bar_index long, open double, high double, low double, close double")
    mixed = draw.sample(rows, len(rows))
    for k in range(3):
        part = mixed[k::3] + mixed[:5] + ([("A", "1h", 70, 1.0, 1.0, 1.0, 1.0)] if k == 0 else [])
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stores = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(stores, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = directional.adx(stream).writeStream.format("memory").queryName("movement").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(100)
        assert q.exception() is None and not q.isActive
    finally:
        spark.conf.unset(stores)
    lines = ["symbol", "bar_index", "plus_di", "minus_di", "adx"]
    got = spark.table("movement").orderBy("symbol", "bar_index").collect()
    want = indicators.adx(df).select(*lines).orderBy("symbol", "bar_index").collect()
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 120
    assert all(abs(x - y) < 1e-9 for a, b in zip(got, want, strict=True) for x, y in zip(a[2:], b[2:], strict=True))
