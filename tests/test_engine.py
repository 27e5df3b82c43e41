"""Goldens, loop implementations and metamorphic checks of the bar engine."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import distributions as d
from tidebar.functions import resample, selection
from tidebar.functions import series as s
from tidebar.operators import causality, events, grid, integrity, reports
from tidebar.operators import indicators as ind
from tidebar.operators import statistics as st
from tidebar.params import AdxParams, SqueezeParams, WaveTrendParams


def walk(n, seed, symbol="A", start=100.0):
    rng = np.random.default_rng(seed)
    close = start * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = np.concatenate([[start], close[:-1]])
    high = np.maximum(open_, close) * (1 + rng.random(n) * 0.01)
    low = np.minimum(open_, close) * (1 - rng.random(n) * 0.01)
    time = pd.date_range("2025-01-01", periods=n, freq="1h")
    return pd.DataFrame({"symbol": symbol, "interval": "1h", "bar_index": np.arange(n), "open_time": time, "close_time": time, "open": open_, "high": high, "low": low, "close": close, "volume": 1.0})


@pytest.fixture(scope="module")
def pdf():
    return walk(700, 0)


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return spark.createDataFrame(pdf)


def frame(df):
    return df.orderBy("symbol", "bar_index").toPandas()


def same(a, b, tol=1e-9):
    for x, y in zip(a, b, strict=True):
        if x is None or y is None or (isinstance(x, float) and math.isnan(x)) or (isinstance(y, float) and math.isnan(y)):
            assert (x is None or math.isnan(x)) and (y is None or math.isnan(y)), (x, y)
        else:
            assert abs(x - y) <= tol * max(1, abs(y)), (x, y)


def loop_squeeze(p, q):
    """Bar by bar from the formulas."""
    h, low, c = (p[k].tolist() for k in ("high", "low", "close"))
    n = len(c)
    tr = [h[i] - low[i] if i == 0 else max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(n)]
    mean = lambda x: sum(x) / len(x)
    out = []
    delta = [None] * n
    for i in range(n):
        row = dict(on=False, off=False, blue=False, val=None, atr=None)
        if i >= max(q.bb_length, q.kc_length) - 1:
            w = c[i - q.bb_length + 1 : i + 1]
            m = mean(w)
            dev = q.bb_mult * math.sqrt(mean([(x - m) ** 2 for x in w]))
            k, r = mean(c[i - q.kc_length + 1 : i + 1]), mean(tr[i - q.kc_length + 1 : i + 1]) * q.kc_mult
            row["on"], row["off"] = m - dev > k - r and m + dev < k + r, m - dev < k - r and m + dev > k + r
            row["blue"] = not row["on"] and not row["off"]
        ml = q.momentum_length
        if i >= ml - 1:
            delta[i] = c[i] - ((max(h[i - ml + 1 : i + 1]) + min(low[i - ml + 1 : i + 1])) / 2 + mean(c[i - ml + 1 : i + 1])) / 2
        if i >= 2 * ml - 2:
            slope, cut = np.polyfit(range(ml), delta[i - ml + 1 : i + 1], 1)
            row["val"] = cut + slope * (ml - 1)
        if i >= q.atr_length - 1:
            row["atr"] = mean(tr[i - q.atr_length + 1 : i + 1])
        out.append(row)
    return out


@pytest.mark.parametrize("q", [SqueezeParams(kc_mult=1.0), SqueezeParams(bb_length=14, kc_length=30, kc_mult=1.5, momentum_length=10, atr_length=50)])
def test_squeeze_against_loops(bars, pdf, q):
    got, want = frame(ind.squeeze(bars, q)), loop_squeeze(pdf, q)
    same(got["val"], [r["val"] for r in want])
    same(got["atr_norm"], [r["atr"] for r in want])
    for name, k in (("sqz_on", "on"), ("sqz_off", "off"), ("no_sqz", "blue")):
        assert got[name].tolist() == [r[k] for r in want]
    run, before, released = 0, [], []
    for i, r in enumerate(want):
        before.append(run)
        run = run + 1 if r["on"] else 0
        assert got["squeeze_run"][i] == run and got["squeeze_run_before"][i] == before[-1]
        released.append(r["off"] and i > 0 and want[i - 1]["on"])
    assert got["released"].tolist() == released and any(released)


def recur(x, a):
    out, y = [], None
    for v in x:
        y = v if y is None else (1 - a) * y + a * v
        out.append(y)
    return out


def test_wavetrend_and_adx_against_loops(bars, pdf):
    w, a = frame(ind.wavetrend(bars)), frame(ind.adx(bars))
    ap = ((pdf.high + pdf.low + pdf.close) / 3).tolist()
    esa = recur(ap, 2 / 11)
    dd = recur([abs(x - y) for x, y in zip(ap, esa, strict=True)], 2 / 11)
    ci = [None if v == 0 else (x - y) / (0.015 * v) for x, y, v in zip(ap, esa, dd, strict=True)]
    wt1 = [None, *recur(ci[1:], 2 / 22)]
    same(w["esa"], esa)
    same(w["wt1"], wt1)
    assert w["wt2"].isna().sum() == 4 and not (w.cross_up & w.cross_down).any() and w.cross_up.sum() > 10
    h, low, c = pdf.high.tolist(), pdf.low.tolist(), pdf.close.tolist()
    pdm, mdm, tr = [0.0], [0.0], [h[0] - low[0]]
    for i in range(1, len(c)):
        up, down = h[i] - h[i - 1], low[i - 1] - low[i]
        pdm.append(up if up > down and up > 0 else 0.0)
        mdm.append(down if down > up and down > 0 else 0.0)
        tr.append(max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])))
    t, p, m = (recur(x, 1 / 14) for x in (tr, pdm, mdm))
    dx = [0.0 if x + y == 0 else 100 * abs(100 * x / z - 100 * y / z) / (100 * x / z + 100 * y / z) for x, y, z in zip(p, m, t, strict=True)]
    line = recur(dx, 1 / 14)
    same(a["adx"], line)
    assert a["cross_threshold"].tolist() == [False] + [line[i] > 20 >= line[i - 1] for i in range(1, len(line))]
    assert ((a.adx >= 0) & (a.adx <= 100)).all()


def test_directional_movement_golden(spark):
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "interval": "1h", "bar_index": range(4), "open": 100.0, "high": [110.0, 115, 113, 116], "low": [90.0, 87, 83, 80], "close": 100.0}))
    got = frame(ind.adx(df))
    assert got.plus_dm.tolist() == [0, 5, 0, 0] and got.minus_dm.tolist() == [0, 0, 4, 0]


def test_null_in_smoothing_decays_its_weight():
    same(s._ewm(pd.Series([1.0, np.nan, 3.0]), 0.5), [1.0, 1.0, 7 / 3])


def test_linreg_is_exact_on_a_line(spark):
    df = spark.createDataFrame([("A", "1h", i, -7.0 + 3 * i) for i in range(500)], "symbol string, interval string, bar_index long, y double")
    got = df.withColumn("v", s.rolling_linreg(df, F.col("y"), 20)).orderBy("bar_index").toPandas()
    assert got.v.isna().sum() == 19
    same(got.v[19:], got.y[19:], 1e-10)


@pytest.mark.parametrize("f", [lambda b, n: ind.squeeze(b, SqueezeParams(kc_mult=1.0), n), lambda b, n: ind.wavetrend(b, WaveTrendParams(), n), lambda b, n: ind.adx(b, AdxParams(), n)])
def test_chunks_don_t_change_results(bars, f):
    whole, cut = frame(f(bars, s.CHUNK_BARS)), frame(f(bars, 97))
    assert len(whole) == len(cut)
    for c in whole.columns:
        if whole[c].dtype == float:
            same(cut[c], whole[c], 1e-9)
        else:
            assert whole[c].astype(str).tolist() == cut[c].astype(str).tolist(), c


def test_scale_and_symbol_isolation(spark, pdf, bars):
    big = pdf.assign(**{k: pdf[k] * 1000 for k in ("open", "high", "low", "close")})
    one, two = frame(ind.squeeze(bars, SqueezeParams(kc_mult=1.0))), frame(ind.squeeze(spark.createDataFrame(big), SqueezeParams(kc_mult=1.0)))
    same(two.val, one.val * 1000, 1e-7)
    same(two.val_norm, one.val_norm, 1e-7)
    assert two.sqz_on.tolist() == one.sqz_on.tolist()
    both = spark.createDataFrame(pd.concat([pdf, walk(300, 9, "B")]))
    same(frame(ind.wavetrend(both).where("symbol = 'A'")).wt1, frame(ind.wavetrend(bars)).wt1)


def test_targets_and_releases_by_hand(bars, pdf):
    got = frame(events.with_targets(bars, (1, 6), None))
    assert abs(got.ret_6_bps[10] - (pdf.close[16] / pdf.open[11] - 1) * 1e4) < 1e-8
    assert got.ret_6_bps.isna().sum() == 6
    study = events.studied(bars, SqueezeParams(kc_mult=1.0))
    rows = events.events(study).toPandas()
    assert (rows.bar_index >= 101).all() and (rows.groupby("bar_index").size() == 6).all()
    q = frame(ind.squeeze(bars, SqueezeParams(kc_mult=1.0)))
    for r in rows.itertuples():
        assert q.sqz_off[r.bar_index] and q.sqz_on[r.bar_index - 1] and r.run_before == q.squeeze_run[r.bar_index - 1]
    with pytest.raises(ValueError):
        events.is_release("green")


def test_groups_follow_recent_releases(bars):
    led = events.leader_bars(bars, "wavetrend", SqueezeParams(kc_mult=1.0))
    q = frame(led)
    got = events.signals(led, "wavetrend").toPandas().drop_duplicates("bar_index")
    assert len(got) > 5
    for r in got.itertuples():
        near = q.released[max(0, r.bar_index - 5) : r.bar_index + 1].any()
        assert r.group == ("S1" if near else "S2" if q.sqz_on[r.bar_index] else "S3")
        assert r.direction == (1 if q.cross_up[r.bar_index] else -1)


def test_thinning_golden(spark):
    df = spark.createDataFrame([("A", 6, i) for i in (0, 2, 5, 9, 10, 20, 21, 40)], "symbol string, horizon int, bar_index long")
    assert sorted(r.bar_index for r in st.non_overlapping(df, ["symbol"]).collect()) == [0, 9, 20, 40]


def test_tails_of_distributions():
    assert abs(d.t_two_sided(-2.028937745673074, 14423) - 0.0424829625071) < 1e-10
    assert abs(d.f_upper(25.92794421744, 1, 459938) / 3.5454e-07 - 1) < 1e-3
    assert abs(d.t_two_sided(2.0, 10) - 0.07338803477074) < 1e-12 and math.isnan(d.t_two_sided(math.nan, 5))


def test_bootstraps_agree():
    rng = np.random.default_rng(7)
    for n in (500, 5000):
        x = rng.normal(0.3, 5, n)
        b = d.block_length(n)
        one, two = d.moving_block_ci(x, b, 4000), d.block_mean_ci(x, b, 4000)
        width = two[1] - two[0]
        assert max(abs(p - q) for p, q in zip(one, two, strict=True)) < 0.1 * width
    assert all(math.isnan(v) for v in d.block_mean_ci(x[:15], 10)) and all(math.isnan(v) for v in d.difference_ci(x[:10], x))


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", None), ("a", 2.0)], "g string, v double")
    got = df.select("v", st.average_rank(F.col("v"), ["g"], True).alias("r"), st.percentile_rank(F.col("v"), ["g"]).alias("p")).toPandas().sort_values("v")
    assert got.r.tolist()[:4] == [4.0, 3.0, 1.5, 1.5] and got.p.tolist()[:4] == [0.25, 0.5, 0.875, 0.875]


def test_grid_of_settings(spark):
    g = grid.build_grid()
    assert len(g) == 65 and g[0].key == "adx[length=7, threshold=15.0]"
    near = grid.neighbours(grid.grid_frame(spark, g)).toPandas()
    want = {(a.key, b.key) for a in g for b in g if a.family == b.family and sum(abs(x - y) for x, y in zip(a.axis_index, b.axis_index, strict=True)) == 1}
    assert set(near.itertuples(index=False, name=None)) == want


def test_grid_signals_match_single_indicators(bars):
    some = [x for x in grid.build_grid() if x.key in ("adx[length=14, threshold=20.0]", "wavetrend[n1=10, n2=21, mode=zone]", "squeeze[bb_length=20, kc_length=14, kc_mult=1.0]")]
    got = grid.grid_signals(grid.context_of(bars), some, 120).where("horizon = 1").toPandas()
    a, w = frame(ind.adx(bars)), frame(ind.wavetrend(bars))
    q = frame(ind.squeeze(bars, SqueezeParams(kc_length=14, kc_mult=1.0)))
    hits = {some[0].key: a.cross_threshold, some[1].key: (w.cross_up & w.oversold_zone) | (w.cross_down & w.overbought_zone), some[2].key: q.released & q.val.notna()}
    for x in some:
        assert sorted(got[got.setting_key == x.key].bar_index) == [i for i in np.flatnonzero(hits[x.key]) if i >= 120], x.key


@pytest.mark.parametrize("name", list(causality.NEGATIVE_CONTROLS))
def test_checker_catches_controls(spark, name):
    bars = spark.createDataFrame(walk(260, 3)).select("symbol", "interval", "bar_index", "open", "high", "low", "close")
    with pytest.raises(causality.LookAheadError):
        causality.assert_no_look_ahead(causality.NEGATIVE_CONTROLS[name], bars)


@pytest.mark.parametrize("builder", [lambda b: ind.squeeze(b).drop("squeeze_run", "squeeze_run_before"), ind.wavetrend, ind.adx])
def test_indicators_are_causal(spark, builder):
    bars = spark.createDataFrame(walk(330, 3)).select("symbol", "interval", "bar_index", "open", "high", "low", "close")
    causality.assert_no_look_ahead(builder, bars, 102)


def test_builders_with_lines_share_a_pass_that_sends_the_wanted_bars(spark):
    bars = spark.createDataFrame(pd.concat([walk(900, 3), walk(330, 4, "B")])).select("symbol", "interval", "bar_index", "open", "high", "low", "close")
    kinds = {"squeeze": ind.squeeze, "wavetrend": ind.wavetrend, "adx": ind.adx}
    (fused,) = causality.together(kinds)
    assert fused.names == list(kinds)
    some = F.col("bar_index") % 97 == 5
    at = ["symbol", "bar_index"]
    got = fused(bars.withColumn("wanted", some)).drop("wanted").orderBy(*at).toPandas()
    assert len(got) == 14
    for name, f in kinds.items():
        want = f(bars).where(some).orderBy(*at).toPandas()
        made = [c for c in want.columns if c not in bars.columns]
        assert made
        for c in made:
            pd.testing.assert_series_equal(got[f"{name}/{c}"], want[c], check_names=False, check_exact=True)
    # runs over several chunks, of all bars and of those wanted
    p = SqueezeParams(kc_mult=3.0)
    flags = ind.squeeze(bars, p, runs=False)
    want = s.run_length(flags, "sqz_on", "squeeze_run").select(*at, "squeeze_run", "squeeze_run_before").orderBy(*at)
    assert want.agg(F.max("squeeze_run")).first()[0] > 100
    for rows, kept in ((bars, want), (bars.withColumn("wanted", some), want.where(some))):
        assert ind.squeeze(rows, p, chunk_bars=50).select(*want.columns).orderBy(*at).collect() == kept.collect()

    @causality.reaching(0)
    @causality.lined(lambda b: {"x": b["close"].shift(-1)}, {"x": "double"}, 0)
    def late(df):
        raise AssertionError("its lines are used")

    (fused,) = causality.together({"late": late})
    cuts = causality.cut_positions(330)
    found = causality.differences(fused, bars.where("symbol = 'B'"), cuts).collect()
    assert {(r.cut, r.column, r.changed, r.first_index) for r in found} == {(c, "late/x", 1, c - 1) for c in cuts}


def test_checks_run_on_whole_series_with_runs(spark, monkeypatch):
    from tidebar import queries

    both = pd.concat([walk(1500, 3), walk(330, 4, "B"), walk(8, 5, "C")])
    plain = spark.createDataFrame(both)
    cuts = {r.symbol: r.cuts for r in causality.series_cuts(plain, 102).collect()}
    assert cuts == {"A": causality.cut_positions(1500, 102), "B": causality.cut_positions(330, 102)}
    late = lambda b: b.withColumn("squeeze_run", F.when(F.col("bar_index") >= 1300, F.lead("close", 1).over(s.over(b))))
    monkeypatch.setattr(queries, "bars2", lambda *_: plain)
    monkeypatch.setattr(causality, "NEGATIVE_CONTROLS", {"late": late})
    caught = sum(c > 1300 for c in causality.cut_positions(1500))
    assert [tuple(r) for r in queries.negative_controls(spark, "").collect()] == [("late", caught)]
    for name in ("squeeze", "wavetrend", "adx"):
        monkeypatch.setattr(queries.ind, name, late if name == "squeeze" else lambda b: b.withColumn("x", F.col("close")))
    found = queries.causality_check(spark, "").collect()
    assert [(r.builder, r.column) for r in found] == [("squeeze", "squeeze_run")] and found[0].changed == sum(c > 1300 for c in cuts["A"])


@pytest.mark.parametrize("reach", [None, 30])
def test_checker_finds_swapped_dropped_and_repeated_rows(spark, reach):
    bars = spark.createDataFrame(walk(400, 3)).select("symbol", "interval", "bar_index", "open", "high", "low", "close")
    last = lambda b: F.col("bar_index") == F.max("bar_index").over(causality._whole(b))
    plain = bars.withColumn("x", F.col("close"))
    builders = {
        "swaps": lambda b: plain_of(b).withColumn("bar_index", F.when(last(b), F.col("bar_index") + 1).otherwise(F.col("bar_index"))),
        "drops": lambda b: plain_of(b).withColumn("_last", last(b)).where("not _last").drop("_last"),
        "repeats": lambda b: plain_of(b).union(plain_of(b).withColumn("_last", last(b)).where("_last").drop("_last")),
    }
    plain_of = lambda b: b.withColumn("x", F.col("close"))
    cuts = causality.cut_positions(400)
    assert plain.count() == 400
    for name, f in builders.items():
        f = causality.reaching(reach)(f)
        found = {(r.cut, r.column): (r.changed, r.first_index) for r in causality.differences(f, bars, cuts).collect()}
        assert set(found) == {(c, causality.ROWS) for c in cuts}, name
        assert found[cuts[3], causality.ROWS] == {"swaps": (2, cuts[3] - 1), "drops": (1, cuts[3] - 1), "repeats": (1, cuts[3] - 1)}[name]


def test_a_reach_holds_its_builder_and_a_short_one_is_found(spark):
    bars = spark.createDataFrame(walk(900, 3)).select("symbol", "interval", "bar_index", "open", "high", "low", "close")
    mean = lambda b: b.withColumn("x", F.avg("close").over(s.last(b, 200)))
    cuts = causality.cut_positions(900)
    assert causality.differences(causality.reaching(199)(mean), bars, cuts).count() == 0
    assert causality.differences(causality.reaching(100)(mean), bars, cuts).count() > 0
    far = lambda b: b.withColumn("x", F.lead("close", 150).over(s.over(b)))
    caught = {r.cut for r in causality.differences(causality.reaching(0)(far), bars, cuts).select("cut").distinct().collect()}
    assert caught == {c for c in cuts if c - causality.COMPARED < 750}  # the bars from 750 on have nothing 150 bars ahead


def test_a_cut_repeats_only_what_its_reach_needs(spark):
    bars = spark.createDataFrame(walk(3000, 3)).select("symbol", "interval", "bar_index", "open", "high", "low", "close")
    cuts = causality.series_cuts(bars).select(*s.SERIES, F.explode("cuts").alias("cut"))
    near = causality._within(bars, causality._anchored(cuts, bars, 20))
    assert near.count() <= cuts.count() * (causality.COMPARED + 20)
    assert near.groupBy("cut").agg((F.max("bar_index") == F.col("cut") - 1).alias("ok")).where("not ok").count() == 0


def _mixed(v):
    a = (v * 1103515245 + 12345) % 2147483647
    b = ((a ^ (a >> 15)) * 1588635695 + 12345) % 2147483647
    return b ^ (b >> 13)


def _plain_rounds(x, times, seed):
    """The same draws as loops over arrays."""
    n = len(x)
    length = max(10, round(n ** (1 / 3)))
    whole, rest = n // length, n % length
    u = _mixed(seed + np.arange(times))
    k = np.arange(whole + (rest > 0))
    at = _mixed(_mixed(u[:, None] + k) ^ _mixed(u + resample.APART)[:, None]) * (n - length + 1) // 2147483648
    sums = np.concatenate([[0.0], np.cumsum(x)])
    full = (sums[at[:, :whole] + length] - sums[at[:, :whole]]).sum(axis=1)
    part = sums[at[:, -1] + rest] - sums[at[:, -1]] if rest else 0.0
    return full / (whole * length), (full + part) / n, at


@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_bootstraps_by_joins_against_loops_and_the_sequential_one(spark, monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    rng = np.random.default_rng(12)
    sizes = {"a": 400, "b": 57, "c": 19, "d": 5, None: 210}
    rows = [(k, s, i, float(v)) for k, n in sizes.items() for (s, i), v in zip([(s, i) for s in "XY" for i in range(0, 3 * n, 2)][:n], rng.normal(1, 10, n))]
    df = spark.createDataFrame([*rows, ("a", "X", 999_999, None)], "k string, symbol string, bar_index long, x double").repartition(3)
    got = {(r.k, r.method): r for r in st.bootstraps(df, ["k"], "x", ["symbol", "bar_index"]).collect()}
    assert len(got) == 2 * len(sizes)
    for k, n in sizes.items():
        x = np.array([v for c, _, _, v in rows if c == k])
        blocks, moving = (got[k, m] for m in st.METHODS)
        assert blocks.n == n and np.isclose(blocks.mean, x.mean())
        if n < 20:
            assert blocks.ci_low is None and moving.ci_high is None
            continue
        one, two, at = _plain_rounds(x, 10_000, resample.BOOTSTRAP_SEED)
        assert np.allclose([blocks.ci_low, blocks.ci_high], np.percentile(one, [2.5, 97.5])) and np.allclose([moving.ci_low, moving.ci_high], np.percentile(two, [2.5, 97.5]))
        length = d.block_length(n)
        seq = d.block_mean_ci(x, length)
        assert np.allclose([blocks.ci_low, blocks.ci_high], seq, atol=0.06 * (seq[1] - seq[0]))
        # starts are even, and rounds differ
        share = np.bincount(at.ravel(), minlength=n - length + 1) / at.size * (n - length + 1)
        assert abs(share - 1).max() < 0.2 and len(np.unique(at, axis=0)) == 10_000
    only = st.bootstrap(df, ["k"], "x", ["symbol", "bar_index"], "moving").where("k = 'a'").first()
    assert only.ci_low == got["a", "moving"].ci_low and "method" not in only.asDict()


def test_difference_of_resampled_sides(spark):
    rng = np.random.default_rng(13)
    rows = [("g", i % 3 == 0, "X", i, float(v)) for i, v in enumerate(rng.normal(0, 5, 300))] + [("h", i < 5, "X", i, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, side boolean, symbol string, bar_index long, x double")
    got = {r.k: r for r in st.bootstrap_difference(df, ["k"], "side", "x", ["symbol", "bar_index"]).collect()}
    a, b = (np.array([x for k, s, _, _, x in rows if k == "g" and s == side]) for side in (True, False))
    apart = _plain_rounds(a, 10_000, resample.BOOTSTRAP_SEED)[0] - _plain_rounds(b, 10_000, resample.BOOTSTRAP_SEED + 10_000)[0]
    assert (got["g"].n_a, got["g"].n_b) == (100, 200) and np.allclose([got["g"].ci_low, got["g"].ci_high], np.percentile(apart, [2.5, 97.5]))
    seq = d.difference_ci(a, b)
    assert np.allclose([got["g"].ci_low, got["g"].ci_high], seq, atol=0.06 * (seq[1] - seq[0]))
    assert (got["h"].n_a, got["h"].n_b, got["h"].ci_low) == (5, 35, None)


def test_runs_are_causal(spark):
    bars = spark.createDataFrame(walk(330, 3)).select("symbol", "interval", "bar_index", "open", "high", "low", "close")
    builder = lambda b: ind.squeeze(b, SqueezeParams(kc_mult=1.0)).select(*[c for c in (*s.SERIES, "cut", "bar_index") if c in b.columns], "squeeze_run", "squeeze_run_before")
    assert causality.differences(builder, bars, causality.series_cuts(bars, 102)).count() == 0


def test_leading_keeps_the_order(spark):
    rng = np.random.default_rng(8)
    powers = 2.0 ** np.arange(-1074, 1024, 7)
    x = np.concatenate([rng.normal(size=500), powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), [0.0, -0.0, 5e-324, 1.7976931348623157e308, np.inf]])
    x = np.sort(np.concatenate([x, -x]))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "i": np.arange(len(x))}))
    got = df.select("i", *[selection.leading(F.col("x"), b).alias(f"b{b}") for b in (4, selection.BITS)]).orderBy("i").toPandas()
    for b in (4, selection.BITS):
        y = got[f"b{b}"].to_numpy()
        assert (np.diff(y[np.isfinite(y)]) >= 0).all() and (np.abs(y) <= np.abs(x)).all()
        normal = (np.abs(x) > 1e-300) & np.isfinite(x)
        assert (np.abs(y - x)[normal] <= np.abs(x)[normal] * 2.0**-b).all()


@pytest.mark.parametrize("kind", ["normal", "narrow", "ties", "wide"])
def test_moments_and_medians_against_pandas(spark, kind):
    rng = np.random.default_rng(9)
    n = 3001
    x = {"normal": rng.normal(size=n) * 50, "narrow": 1e6 + rng.random(n) * 1e-5, "ties": rng.integers(-2, 3, n).astype(float), "wide": np.exp(rng.normal(size=n) * 40) * rng.choice([-1, 1], n)}[kind]
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2999, 0.0001]), "x": x})
    pdf.loc[0, "k"] = "one"
    pdf.loc[1:4, "k"] = None
    df = spark.createDataFrame([(k, float(v)) for k, v in pdf.itertuples(index=False)] + [("a", None), ("empty", None)], "k string, x double")
    got = st.summary(df, ["k"], "x").toPandas().set_index("k")
    for k, v in pdf.groupby("k", dropna=False)["x"]:
        r = got.loc[k] if isinstance(k, str) else got[got.index.isna()].iloc[0]
        assert r["n"] == len(v) and r["median"] == v.median() and np.isclose(r["mean"], v.mean(), rtol=1e-12, atol=0 if kind == "narrow" else 1e-12 * v.abs().max())
        assert np.isclose(r["win_rate"], (v > 0).mean()) and (np.isnan(r["std"]) if len(v) == 1 else np.isclose(r["std"], v.std(), rtol=1e-5 if kind == "narrow" else 1e-9))
    assert "empty" not in got.index


@pytest.mark.parametrize("descending", [False, True])
def test_average_ranks_against_pandas(spark, descending):
    rng = np.random.default_rng(14)
    pdf = pd.DataFrame({"i": np.arange(900), "k": rng.choice(["a", "b", None], 900), "x": np.where(rng.random(900) < 0.5, rng.normal(size=900), rng.integers(-3, 3, 900))})
    pdf.loc[::37, "x"] = np.nan
    df = spark.createDataFrame([(int(i), k, None if np.isnan(x) else float(x)) for i, k, x in pdf.itertuples(index=False)], "i long, k string, x double")
    got = {r.i: r for r in selection.average_ranks(df, ["k"], "x", "rank", "of", descending).collect()}
    want = pdf.groupby("k", dropna=False)["x"].rank(ascending=not descending)
    n = pdf.groupby("k", dropna=False)["x"].transform("count")
    assert len(got) == 900
    for i in range(900):
        assert (got[i]["rank"] is None and np.isnan(want[i])) or (got[i]["rank"] == want[i] and got[i].of == n[i])


def test_no_task_holds_a_cell(spark):
    """Rows of a whole cell meet in no window: of 40,000 distinct values at most a bin's are in one."""
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.randn(3).alias("x"))
    values = selection.counted(df, ["k"], F.col("x")).withColumn("_bin", selection.leading(F.col("_x")))
    assert values.groupBy("_bin").count().agg(F.max("count")).first()[0] < 100
    want = np.median(df.toPandas()["x"])
    assert selection.medians(df, ["k"], F.col("x")).first()["median"] == want


@pytest.mark.parametrize("chunk", [1, 4, 16, 1 << 16])
def test_thinning_by_pieces_against_a_plain_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(st, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = [(s, h, int(i)) for s in ("A", "B", None) for h in (1, 6) for i in np.flatnonzero(rng.random(200) < {"A": 0.05, "B": 0.4}.get(s, 1.0))]
    want, last = set(), {}
    for s, h, i in rows:
        if i - last.get((s, h), -100) > h:
            want.add((s, h, i))
            last[s, h] = i
    got = [tuple(r) for r in st.non_overlapping(spark.createDataFrame(rows, "symbol string, horizon int, bar_index long"), ["symbol"]).collect()]
    assert len(got) == len(want) and set(got) == want


def test_chunks_of_a_gapless_series_are_thinned_apart(spark, monkeypatch):
    """An event at every bar: no chunk ends the others' dependence, and none is thinned in one task with another."""
    monkeypatch.setattr(st, "CHUNK", 64)
    seen = spark.sparkContext.accumulator(0)
    whole = st._kept

    def counted(places, far, free):
        seen.add(1 if len(places) <= 64 else 1_000_000)
        return whole(places, far, free)

    monkeypatch.setattr(st, "_kept", counted)
    rows = spark.range(5000).select(F.lit("A").alias("symbol"), F.lit(6).alias("horizon"), F.col("id").alias("bar_index"), F.when(F.col("id") % 2 == 0, F.col("id") + (1 << 60)).alias("big"))
    got = sorted(map(tuple, st.non_overlapping(rows, ["symbol"]).collect()))
    assert got == [("A", 6, i, i + (1 << 60) if i % 2 == 0 else None) for i in range(0, 5000, 7)]
    assert seen.value == -(-5000 // 64)


def test_chunk_functions_against_a_fold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        far, length, begin = int(rng.integers(1, 9)), int(rng.integers(9, 40)), int(rng.integers(0, 5)) * 40
        places = begin + np.sort(rng.integers(0, length, int(rng.integers(0, 30))))
        for e in range(far):
            free = begin + e
            for p in places:
                free = p + far if p >= free else free
            assert st._exits(places, far, begin, length)[e] == max(0, free - begin - length)


@pytest.mark.parametrize("days", [1, 64, 100_000])
def test_overlapping_periods_against_a_nested_loop(spark, days):
    rng = np.random.default_rng(4)
    day = lambda k: datetime.datetime(1969, 1, 1) + datetime.timedelta(days=float(k))
    times = [(i, day(k)) for i, k in enumerate(rng.uniform(0, 1500, 200))] + [(900, day(400)), (901, day(500)), (902, None)]
    periods = [(f"p{i}", day(a), day(a + w)) for i, (a, w) in enumerate(zip(rng.uniform(0, 1400, 12), rng.uniform(-50, 500, 12)))] + [("edge", day(400), day(500))]
    got = reports.in_periods(spark.createDataFrame(times, "i long, t timestamp"), spark.createDataFrame(periods, "period string, begin timestamp, end timestamp"), "t", days)
    want = sorted((i, p) for i, t in times for p, a, b in periods if t is not None and a <= t < b)
    assert sorted((r.i, r.period) for r in got.collect()) == want and (900, "edge") in want and (901, "edge") not in want


def test_spacing_by_spans_against_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(integrity, "SPAN_BARS", 7)
    monkeypatch.setattr(integrity, "SPAN_SECONDS", 5 * 3600)
    rng = np.random.default_rng(6)
    hours = {s: np.cumsum(rng.choice([0, 1, 1, 1, 2, 9], 120)) for s in "AB"}
    rows = [(s, "1h", n, int(h) * 3600) for s, found in hours.items() for n, h in enumerate(found)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, bar_index long, s long").withColumn("open_time", F.timestamp_seconds("s"))
    report = {r.symbol: r for r in integrity.report(bars, {"1h": 60}).collect()}
    faults = {r.symbol: r.faults for r in integrity.spacing_faults(bars, 60).collect()}
    for s, found in hours.items():
        steps = np.diff(found)
        assert faults[s] == (steps != 1).sum()
        assert report[s].irregular_steps == (steps > 1).sum() and report[s].actual_bars == len(set(found))
        assert report[s].duplicated_times == (steps == 0).sum() and report[s].expected_bars == found[-1] - found[0] + 1


def test_true_ranges_agree_where_a_price_is_unknown(spark):
    pdf = walk(60, 21)
    pdf.loc[[5, 17], "high"] = np.nan
    pdf.loc[[9, 18], "low"] = np.nan
    pdf.loc[[12, 17], "close"] = np.nan
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf[["symbol", "interval", "bar_index", "open", "high", "low", "close"]].astype(object).itertuples(index=False)]
    df = spark.createDataFrame(rows, "symbol string, interval string, bar_index long, open double, high double, low double, close double")
    a = {r.bar_index: r.t for r in df.select("bar_index", s.true_range(df).alias("t")).collect()}
    b = {r.bar_index: r.true_range for r in ind.adx(df).collect()}
    assert all((a[i] is None and b[i] is None) or np.isclose(a[i], b[i]) for i in a) and a[5] is not None


@pytest.mark.parametrize("alpha, chunk", [(2 / 11, 17), (1 / 14, 1 << 17), (1.0, 40), (0.02, 50)])
def test_scan_of_affine_maps_is_plain_smoothing(spark, alpha, chunk):
    """Chunks without any value, gaps over borders, NaN and unknown beginnings; a series without values stays unknown."""
    draw = np.random.default_rng(5)
    x = pd.Series(draw.normal(100, 5, 400))
    x[(draw.random(400) < 0.3) | x.index.isin(range(100, 230)) | (x.index < 7)] = np.nan
    rows = [("A", "1h", i, None if np.isnan(v) and i % 2 else float(v)) for i, v in enumerate(x)] + [("B", "1h", i, None) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, interval string, bar_index long, close double")
    got = frame(ind.smoothed(df, alpha, "close", "y", chunk))
    want = x.ewm(alpha=alpha, adjust=False).mean()
    same(got[got.symbol == "A"].y.reset_index(drop=True), want, 1e-12)
    assert got[got.symbol == "B"].y.isna().all() and len(got) == 460
    assert ind.smoothed(df.limit(0), alpha, "close", "y", chunk).count() == 0


def test_controls_repeat_no_prefix(spark, monkeypatch):
    sizes = []
    plain = causality._within
    monkeypatch.setattr(causality, "_within", lambda rows, ranges, *block: sizes.append(plain(rows, ranges, *block).count()) or plain(rows, ranges, *block))
    monkeypatch.setattr(s, "CHUNK_BARS", 512)
    bars = spark.createDataFrame(walk(3000, 3)).select("symbol", "interval", "bar_index", "open", "high", "low", "close")
    cuts = causality.series_cuts(bars)
    n = len(causality.cut_positions(3000))
    for builder in causality.together(causality.NEGATIVE_CONTROLS):
        causality.differences(builder, bars, cuts).count()
    assert max(sizes) <= n * max(causality.COMPARED + 20, causality.BLOCK)
    close = frame(bars).sort_values("bar_index").close
    made = {k: frame(causality.NEGATIVE_CONTROLS[k](bars)).sort_values("bar_index").bad.to_numpy() for k in ("future_peak", "back_filled", "next_close")}
    assert (made["future_peak"] == close[::-1].cummax()[::-1].to_numpy()).all()
    assert (made["back_filled"] == close.where(np.arange(3000) % 50 != 0).bfill().to_numpy()).all()
    assert (made["next_close"][:-1] == close.to_numpy()[1:]).all() and np.isnan(made["next_close"][-1])


def test_totals_before_cuts_over_gaps(spark):
    index = [*range(0, 1500), *range(9000, 9100)]
    bars = spark.createDataFrame([("A", "x", i, float(i % 7)) for i in index], "symbol string, interval string, bar_index long, close double")
    cuts = spark.createDataFrame([("A", "x", c) for c in (1, 1024, 1400, 5000, 9050, 9100)], "symbol string, interval string, cut int")
    totals = {"_s": ("sum", lambda: F.col("close")), "_n": ("count", lambda: F.col("close")), "_m": ("max", lambda: F.col("bar_index"))}
    for r in causality._totals_before(bars, cuts, totals).collect():
        before = [i for i in index if i < r.cut]
        assert (r._s, r._n, r._m) == (sum(i % 7 for i in before), len(before), max(before)), r.cut


def test_bootstraps_by_slices_and_shares(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = rng.normal(1, 10, 700)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, bar_index long, x double")
    for name, small in (("SLICE", 64), ("DRAWS", 100_000), ("AT_ONCE", 50)):
        monkeypatch.setattr(resample, name, small)
    values, cells = resample.sample(df, ["k"], "x", ["bar_index"])
    got = resample.rounds(values, cells, ["k"]).orderBy("round").toPandas()
    one, two, _ = _plain_rounds(x, 10_000, resample.BOOTSTRAP_SEED)
    assert len(got) == 10_000 and np.allclose(got.blocks, one) and np.allclose(got.moving, two)


def test_sums_side_by_side_are_the_cells_of_signals(bars):
    some = [x for x in grid.build_grid() if x.family == "squeeze" or x.params.get("length") == 14]
    context = grid.context_of(bars)
    plain = grid.cells(grid.grid_signals(context, some, 120), 1)
    order = ["setting_key", "interval", "horizon"]
    a = plain.orderBy(*order).toPandas()
    b = grid.pooled(grid.symbol_sums(context, some, 120), 1).orderBy(*order).toPandas()
    pd.testing.assert_frame_equal(a, b, check_exact=False)
    assert len(a)


def _holed(spark, n, seed):
    """Bars of a walk with unknown prices."""
    pdf, draw = walk(n, seed), np.random.default_rng(seed)
    for c in ("high", "low", "close"):
        pdf.loc[draw.random(n) < 0.003, c] = np.nan
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf[["symbol", "interval", "bar_index", "open", "high", "low", "close"]].astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "symbol string, interval string, bar_index long, open double, high double, low double, close double").withColumn("close_time", F.timestamp_seconds(F.col("bar_index") * 3600))


def test_frames_in_arrays_are_those_of_windows(spark):
    """The very same doubles, in chunks too, with unknown prices."""
    df = _holed(spark, 1500, 31)
    close = F.col("close")
    x = df.withColumn("tr", s.true_range(df))
    x = x.withColumns({"mean": s.sma(x, close, 20), "deviation": s.population_std(x, close, 20) * 2.0, "range": s.sma(x, F.col("tr"), 20), "atr": s.sma(x, F.col("tr"), 100), "line": s.rolling_linreg(x, close, 20)})
    want, got = frame(x), frame(ind.squeeze(df, chunk_bars=400, runs=False))
    for a, b in (("tr", "true_range"), ("mean", "basis"), ("deviation", "dev"), ("range", "rangema"), ("atr", "atr_norm")):
        assert np.array_equal(want[a].to_numpy(float), got[b].to_numpy(float), equal_nan=True), b
    c = frame(df)
    assert np.array_equal(want["line"].to_numpy(float), s.regressed(c["close"].to_numpy(float), c["bar_index"].to_numpy(float), 20), equal_nan=True)
    assert len(s.means(np.arange(3.0), 20)) == 3 and len(s.deviations(np.arange(3.0), 20)) == 3


@pytest.mark.parametrize("variant", events.VARIANTS)
def test_leaders_in_one_pass_are_those_of_their_bars(spark, variant):
    df = _holed(spark, 2500, 32)
    p = SqueezeParams(kc_mult=1.0)
    want = events.signals(events.leader_bars(df, "wavetrend", p), "wavetrend", variant).unionByName(events.signals(events.leader_bars(df, "adx", p), "adx", variant))
    got = events.leader_signals(df, variant, params=p, chunk_bars=700)
    order = ["leader", "bar_index", "horizon"]
    a, b = want.orderBy(*order).toPandas(), got.orderBy(*order).toPandas()[want.columns]
    assert len(a) > 50 and set(a["leader"]) == set(events.LEADERS)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_grid_by_chunks_is_the_grid_of_whole_series(spark):
    """Each chunk is summed in its task; of signals over the border each counts once."""
    df = _holed(spark, 2500, 33)
    order = ["setting_key", "interval", "horizon", "symbol"]
    a, b = (grid.symbol_sums(grid.context_of(df, n), grid.build_grid(), 120).orderBy(*order).toPandas() for n in (1 << 17, 700))
    assert len(a) > 100
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_the_same_events_give_the_same_cells_in_any_order(spark, monkeypatch):
    """Both definitions are summed from one reading of the study, whose rows come in another order each time."""
    from tidebar import queries

    rng = np.random.default_rng(41)
    n, read = 4000, spark.sparkContext.accumulator(0)
    pdf = pd.DataFrame({"symbol": "A", "interval": "1h", "bar_index": np.arange(n), "val_sign": rng.choice([-1.0, 1.0], n), "valid": True, "released": rng.random(n) < 0.5, "became_blue": False, "close_time": pd.Timestamp("2020-01-01")})
    for h in queries.HORIZONS:
        pdf[f"ret_{h}_bps"], pdf[f"ret_{h}_atr"] = np.exp(rng.normal(size=n) * 9) * rng.choice([-1, 1], n), 0.0
    base = spark.createDataFrame(pdf).repartition(5)

    def shuffled(parts):
        for part in parts:
            read.add(len(part))
            yield part.sample(frac=1.0)

    monkeypatch.setattr(queries, "_study", lambda spark, sf: base.mapInPandas(shuffled, base.schema))
    assert [tuple(r) for r in queries.result_identity(spark, "").collect()] == [(len(queries.HORIZONS), 0, True)]
    assert read.value == n


def test_values_of_a_bootstrap_move_packed_and_few_times(spark, monkeypatch):
    """What tasks draw from are pieces of many values, of which a cell's shares of the rounds take at most SHARES copies."""
    rng = np.random.default_rng(42)
    x = rng.normal(1, 10, 900)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, bar_index long, x double")
    monkeypatch.setattr(resample, "DRAWS", 1000)  # 910 shares of the rounds' draws
    moved = spark.sparkContext.accumulator(0)
    values, cells = resample.sample(df.repartition(4), ["k"], "x", ["bar_index"])

    def seen(parts):
        for part in parts:
            moved.add(part.num_rows)
            yield part

    plain = resample._drawn
    monkeypatch.setattr(resample, "_drawn", lambda *a: (moved.add(len(a[0])), plain(*a))[1])
    got = resample.rounds(values.mapInArrow(seen, values.schema), cells, ["k"]).orderBy("round").toPandas()
    one, two, _ = _plain_rounds(x, 10_000, resample.BOOTSTRAP_SEED)
    assert len(got) == 10_000 and np.allclose(got.blocks, one) and np.allclose(got.moving, two)
    assert moved.value <= 1 + 4 * len(x)


def test_coarse_bins_keep_the_order_and_are_few(spark):
    rng = np.random.default_rng(43)
    powers = 2.0 ** np.arange(-1074, 1024, 7)
    x = np.concatenate([rng.normal(size=20_000) * 1e4, powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), [0.0, -0.0, 5e-324, 1.7976931348623157e308, np.inf]])
    x = np.sort(np.concatenate([x, -x]))
    got = spark.createDataFrame(pd.DataFrame({"x": x, "i": np.arange(len(x))})).select("i", selection.coarse(F.col("x")).alias("b")).orderBy("i").toPandas()["b"].to_numpy()
    assert (np.diff(got) >= 0).all() and (got == -got[::-1]).all() and (got[x == 0] == 0).all() and (np.sign(got) == np.sign(x)).all()
    assert len(np.unique(got[(np.abs(x) > 1) & (np.abs(x) < 1e5)])) <= 2 * 17 * selection.COARSE


def test_spreads_are_compared_by_one_reading_of_the_study(spark, monkeypatch):
    from tidebar import queries

    rng = np.random.default_rng(44)
    n, read = 3000, spark.sparkContext.accumulator(0)
    pdf = pd.DataFrame({"symbol": "A", "interval": "1h", "bar_index": np.arange(n), "close_time": pd.Timestamp("2020-01-01"), "val": 1.0, "val_sign": 1.0, "valid": True, "released": rng.random(n) < 0.2, "became_blue": False})
    for h in queries.HORIZONS:
        pdf[f"ret_{h}_bps"], pdf[f"ret_{h}_atr"] = rng.normal(size=n) * 100 * h, 0.0
    base = spark.createDataFrame(pdf).repartition(3)

    def counted(parts):
        for part in parts:
            read.add(len(part))
            yield part

    monkeypatch.setattr(queries, "_study", lambda spark, sf, runs=False: base.mapInPandas(counted, base.schema))
    got = {r.horizon: r for r in queries.volatility_expansion(spark, "").collect()}
    assert read.value == n and len(got) == len(queries.HORIZONS)
    for h in queries.HORIZONS:
        a, b = pdf[pdf.released][f"ret_{h}_bps"], pdf[f"ret_{h}_bps"]
        assert (got[h].n_events, got[h].n_baseline) == (len(a), n) and np.isclose(got[h].std_ratio, a.std() / b.std(), atol=1e-6) and np.isclose(got[h].median_abs_ratio, a.abs().median() / b.abs().median(), atol=1e-6)
