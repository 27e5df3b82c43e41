"""The engine's queries over the driver's tables: one for each operator, on bars of two consecutive line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions import series as s
from tidebar.functions import distributions as d
from tidebar.functions import selection
from tidebar.functions.shared import kept
from tidebar.operators import causality, events, grid, integrity, reports
from tidebar.operators import indicators as ind
from tidebar.operators import statistics as st
from tidebar.params import COSTS_BPS, HORIZONS, RUN_BUCKETS, SqueezeParams
from tidebar.plans import studies
from tidebar.sources import bars as src

#: Prices here are independent draws, so that the default channel hardly ever closes: events need a narrower one.
EVENT_PARAMS = SqueezeParams(kc_mult=1.0)
AT = ["symbol", "interval", "bar_index"]
#: Bars of two parts and of four periods, by share of each series.
PARTS = ((0, 25), (25, 50), (50, 75), (75, 100))


def r6(c) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, and times without a zone, as SQL has them."""
    plain = lambda c, t: r6(c).alias(c) if t == "double" else F.col(c).cast("timestamp_ntz") if t == "timestamp" else F.col(c)
    return df.select(*[plain(c, t) for c, t in df.dtypes])


def bars2(spark: SparkSession, sf: str) -> DataFrame:
    return src.lineitem_bars(spark, sf, 2)


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    """bars2 written once, for queries that read them more than once: each reading numbers the line items anew."""
    return kept(bars2(spark, sf).drop("count"), "bars")


def _study(spark: SparkSession, sf: str, runs: bool = False) -> DataFrame:
    return events.studied(bars2(spark, sf), EVENT_PARAMS, runs=runs)


def _events(spark: SparkSession, sf: str, runs: bool = False) -> DataFrame:
    return events.events(_study(spark, sf, runs))


def bars_rows2(spark, sf):
    return rounded(bars2(spark, sf).drop("count"))


def bars_daily(spark, sf):
    return rounded(src.lineitem_daily(spark, sf))


def bars_events_4h(spark, sf):
    return rounded(src.event_bars(spark, sf))


def integrity_report(spark, sf):
    return integrity.report(src.lineitem_daily(spark, sf), {"1d": 1440})


def missing_times(spark, sf):
    return rounded(integrity.missing_times(src.event_bars(spark, sf, 60, "1h"), 60))


def missing_pattern(spark, sf):
    return integrity.missing_pattern(integrity.missing_times(src.event_bars(spark, sf, 60, "1h"), 60))


def spacing_faults(spark, sf):
    return integrity.spacing_faults(src.event_bars(spark, sf, 60, "1h"), 60)


def true_range(spark, sf):
    b = bars2(spark, sf)
    return rounded(b.select(*AT, s.true_range(b).alias("true_range")))


def _squeeze(spark, sf, params=None, runs=False):
    return ind.squeeze(bars2(spark, sf), params, runs=runs)


def bollinger(spark, sf):
    return rounded(_squeeze(spark, sf).select(*AT, "basis", "dev", "upper_bb", "lower_bb"))


def keltner(spark, sf):
    return rounded(_squeeze(spark, sf).select(*AT, "kc_ma", "rangema", "upper_kc", "lower_kc", "atr_norm"))


def squeeze_states(spark, sf):
    return _squeeze(spark, sf, EVENT_PARAMS).select(*AT, "sqz_on", "sqz_off", "no_sqz")


def squeeze_run(spark, sf):
    return _squeeze(spark, sf, EVENT_PARAMS, runs=True).select(*AT, "squeeze_run")


def color_state(spark, sf):
    return _squeeze(spark, sf).select(*AT, "color_state", "val_rising")


def linreg_momentum(spark, sf):
    return rounded(_squeeze(spark, sf).select(*AT, "val"))


def val_norm(spark, sf):
    return rounded(_squeeze(spark, sf).select(*AT, "val_norm"))


def state_structure(spark, sf):
    """Basis and channel middle are one, so no bar is in neither state, and the squeeze is a plain comparison of widths."""
    q = _squeeze(spark, sf, EVENT_PARAMS)
    same = F.col("sqz_on") == F.coalesce(F.col("dev") < F.col("rangema") * EVENT_PARAMS.kc_mult, F.lit(False))
    return rounded(q.groupBy("symbol", "interval").agg(F.max(F.abs(F.col("basis") - F.col("kc_ma"))).alias("max_difference"), F.count_if("no_sqz").alias("blue_bars"), F.bool_and(same).alias("equivalent")))


def ema(spark, sf):
    return rounded(ind.smoothed(bars2(spark, sf), 2 / 11, "close", "ema").select(*AT, "ema"))


def wilder(spark, sf):
    return rounded(ind.smoothed(bars2(spark, sf), 1 / 14, "close", "wilder").select(*AT, "wilder"))


def wavetrend(spark, sf):
    return rounded(ind.wavetrend(bars2(spark, sf)).select(*AT, "hlc3", "esa", "d", "ci", "wt1", "wt2", "cross_up", "cross_down", "oversold_zone", "overbought_zone"))


def adx(spark, sf):
    return rounded(ind.adx(bars2(spark, sf)).select(*AT, "true_range", "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx", "cross_threshold", "cross_secondary", "bullish"))


def zero_divisions(spark, sf):
    return ind.zero_divisions(ind.wavetrend(bars2(spark, sf)), "d")


def forward_returns(spark, sf):
    return rounded(events.with_targets(bars2(spark, sf), atr=None).select(*AT, *(f"ret_{h}_bps" for h in HORIZONS)))


def release_events(spark, sf):
    return rounded(_events(spark, sf, runs=True).select("symbol", "bar_index", "horizon", "run_before", "utc_hour", "val", "val_norm", "val_sign", "val_rising", "ret_bps", "ret_atr"))


def baseline_bars(spark, sf):
    return rounded(events.baseline(_study(spark, sf)).groupBy("symbol", "horizon").agg(F.count("*").alias("bars"), F.count("ret_bps").alias("n"), F.avg("ret_bps").alias("mean_bps"), F.avg("ret_atr").alias("mean_atr")))


def bar_move(spark, sf):
    return rounded(events.bar_move(bars2(spark, sf)))


def release_definitions(spark, sf):
    """Events of each definition by symbol; any is the union of the two others."""
    q = _study(spark, sf).where("valid")
    n = [F.count_if(events.is_release(x)).alias(x) for x in events.DEFINITIONS]
    return q.groupBy("symbol").agg(*n, F.count("*").alias("bars"))


def event_totals(spark, sf):
    """Events and bars of each series, and what a bar moves against the costs."""
    return rounded(events.totals(_study(spark, sf)))


def _moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return rounded(st.summary(df, by, value))


def direction_summary(spark, sf):
    return _moments(_events(spark, sf), ["interval", "horizon"], "signed_bps")


def direction_accel(spark, sf):
    fast = ((F.col("val") > 0) & F.col("val_rising")) | ((F.col("val") <= 0) & ~F.col("val_rising"))
    return _moments(_events(spark, sf).where(fast), ["interval", "horizon"], "signed_bps")


def per_symbol(spark, sf):
    return _moments(_events(spark, sf), ["symbol", "horizon"], "signed_bps")


def leave_one_out(spark, sf):
    """Each symbol excluded in turn, and none: a row goes to the exclusions of the other symbols, which are few."""
    rows = _events(spark, sf)
    others = F.broadcast(rows.select(F.col("symbol").alias("excluded")).distinct().union(rows.sparkSession.createDataFrame([("none",)], "excluded string")))
    return _moments(rows.join(others, F.col("symbol") != F.col("excluded")), ["excluded", "horizon"], "signed_bps")


def _with_period(df: DataFrame, length: DataFrame) -> DataFrame:
    """period: the quarter of the series' bars that a row is in."""
    share = F.col("bar_index") * 100 / F.col("bars")
    which = F.coalesce(*[F.when((share >= a) & (share < b), i) for i, (a, b) in enumerate(PARTS)])
    return df.join(length, "symbol").withColumn("period", which)


def _lengths(bars):
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"))


def period_split(spark, sf):
    bars = _bars(spark, sf)
    rows = events.events(events.studied(bars, EVENT_PARAMS, runs=False))
    return _moments(_with_period(rows, _lengths(bars)), ["period", "horizon"], "signed_bps")


def baseline_direction(spark, sf):
    return _moments(events.baseline(_study(spark, sf)), ["interval", "horizon"], "signed_bps")


def run_buckets(spark, sf):
    """Overlapping buckets: an event is in every bucket whose least run it has."""
    rows = _events(spark, sf, runs=True).where(F.col("signed_bps").isNotNull())
    buckets = F.array_compact(F.array(*[F.when(F.col("run_before") >= m, F.lit(m)) for m in RUN_BUCKETS]))
    tall = rows.withColumn("min_run", F.explode(buckets))
    return rounded(tall.groupBy("min_run", "horizon").agg(F.count("*").alias("n"), F.avg("ret_bps").alias("mean_raw"), F.avg("signed_bps").alias("mean_signed"), st.t_statistic(F.col("signed_bps")).alias("t_stat")).where("n >= 2"))


def hour_of_day(spark, sf):
    """By the closing hour of four-hour bars: all rows count in the size, the means skip nulls."""
    b = events.with_targets(src.event_bars(spark, sf), (6,), None)
    b = b.select(F.hour("close_time").alias("utc_hour"), "ret_6_bps")
    middle = selection.medians(b, ["utc_hour"], F.abs("ret_6_bps")).select("utc_hour", F.col("median").alias("median_abs_bps"))
    by = selection.met(b.groupBy("utc_hour").agg(F.count("*").alias("size"), F.avg("ret_6_bps").alias("mean_bps")), middle, ["utc_hour"], "left")
    total = F.sum("size").over(Window.partitionBy())  # over the hours, of which there are 24
    share = F.col("size") / total
    return rounded(by.select("utc_hour", "size", "mean_bps", "median_abs_bps", share.alias("share"), (share * 24).alias("vs_uniform")))


def volatility_expansion(spark, sf):
    """An event is among the bars it is held against, so that its return counts on both sides of one reading."""
    rows = events.baseline(_study(spark, sf), more=("released",)).where(F.col("ret_bps").isNotNull())
    both = rows.select("horizon", "ret_bps", F.explode(F.when(events.is_release("gray"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("event"))
    return rounded(st.brown_forsythe(both, ["horizon"], F.col("event"), "ret_bps"))


def bar_ranks(spark, sf):
    """Each bar's average rank by its close within its series, and its share of the series."""
    bars = bars2(spark, sf).select(*AT, "close")
    ranked = selection.average_ranks(bars, ["symbol", "interval"], "close", "rank", "of", descending=True)
    return rounded(ranked.select(*AT, "rank", (F.col("rank") / F.col("of")).alias("percentile")))


def _leader_signals(spark, sf, variant="primary"):
    return events.leader_signals(bars2(spark, sf), variant, params=EVENT_PARAMS)


def leader_signals(spark, sf):
    keep = ["leader", "symbol", "bar_index", "horizon", "direction", "secondary", "sqz_on", "recent_release_3", "recent_release_6", "recent_release_12", "group"]
    return rounded(_leader_signals(spark, sf).select(*keep, "signed_bps", "signed_atr"))


def leader_secondary(spark, sf):
    return rounded(_leader_signals(spark, sf, "secondary").groupBy("leader", "symbol", "horizon").agg(F.count("signed_atr").alias("n"), F.avg("signed_atr").alias("mean_atr")))


def leader_summary(spark, sf):
    by = ["leader", "horizon"]
    rows = kept(_leader_signals(spark, sf).where(F.col("signed_atr").isNotNull()).select(*by, "symbol", "signed_atr", "signed_bps"), "signals")
    each = rows.groupBy(*by, "symbol").agg(F.avg("signed_atr").alias("m")).groupBy(*by).agg(st.signs_agree(F.col("m")).alias("signs_agree"))
    bps = rows.groupBy(*by).agg(F.avg("signed_bps").alias("mean_bps"))
    return rounded(st.summary(rows, by, "signed_atr").join(each, by).join(bps, by))


def leader_groups(spark, sf):
    return _moments(_leader_signals(spark, sf), ["leader", "group", "horizon"], "signed_atr")


def group_difference(spark, sf):
    rows = _leader_signals(spark, sf).where(F.col("group").isin("S1", "S3"))
    return rounded(st.welch(rows, ["leader", "horizon"], F.col("group") == "S1", "signed_atr"))


def non_overlap(spark, sf):
    rows = _events(spark, sf).where(F.col("ret_bps").isNotNull()).select("symbol", "horizon", "bar_index", "signed_bps")
    return rounded(st.non_overlapping(rows, ["symbol"]))


def _grid():
    return grid.build_grid()


def grid_settings(spark, sf):
    g = grid.grid_frame(spark, _grid())
    return g.select("family", "label", "setting_key", F.concat_ws(",", F.transform("axis_index", lambda x: x.cast("string"))).alias("axis_index"))


def grid_neighbours(spark, sf):
    return grid.neighbours(grid.grid_frame(spark, _grid()))


def _cells(spark, sf):
    return grid.pooled(_symbol_sums(spark, sf))


def _symbol_sums(spark, sf):
    return grid.symbol_sums(grid.context_of(bars2(spark, sf)), _grid())


def grid_cells(spark, sf):
    return rounded(_cells(spark, sf))


def grid_scores(spark, sf):
    return rounded(grid.scores(grid.ranked(_cells(spark, sf))))


def grid_selection(spark, sf):
    near = grid.neighbours(grid.grid_frame(spark, _grid()))
    return rounded(grid.selection(grid.ranked(_cells(spark, sf)), near))


def plateau(spark, sf):
    near = grid.neighbours(grid.grid_frame(spark, _grid()))
    return rounded(grid.plateau(grid.scores(grid.ranked(_cells(spark, sf))), near).drop("t_stat"))


#: Candidates that part B confirms.
CONFIRMED = ("adx[length=28, threshold=25.0]", "adx[length=14, threshold=25.0]", "squeeze[bb_length=20, kc_length=30, kc_mult=2.0]")


def _confirmed(spark, sf):
    some = [x for x in _grid() if x.key in CONFIRMED]
    bars = _bars(spark, sf)
    return _with_period(grid.grid_signals(grid.context_of(bars), some), _lengths(bars))


def part_b(spark, sf):
    """The later half of each series against the earlier one."""
    rows = _confirmed(spark, sf)
    a, b = grid.confirmation(rows.where("period < 2")), grid.confirmation(rows.where("period >= 2"))
    by = ["setting_key", "interval", "horizon"]
    kept = grid.retention(a, b).select(*by, "retention", "mean_a")
    return rounded(b.join(kept, by, "left"))


def confirmation_table(spark, sf):
    """The whole table of the confirmed candidates on the later half of each series."""
    return rounded(studies.confirmation_table(_confirmed(spark, sf).where("period >= 2")))


def quarterly_stability(spark, sf):
    return rounded(grid.stability(_confirmed(spark, sf), "close_time", 0.85))


def cost_matrix(spark, sf):
    """Which costs the mean less two standard errors is above."""
    cells = st.summary(_events(spark, sf), ["interval", "horizon"], "signed_bps").withColumn("low", F.col("mean") - 2 * F.col("stderr"))
    return rounded(st.cost_matrix(cells.select("interval", "horizon", "low"), "low", COSTS_BPS))


def p_values(spark, sf):
    return rounded(st.with_p_value(st.summary(_events(spark, sf), ["interval", "horizon"], "signed_bps")))


def bootstrap_ci(spark, sf):
    return rounded(st.bootstraps(_events(spark, sf), ["interval", "horizon"], "signed_bps", ["symbol", "bar_index"]))


def bootstrap_diff(spark, sf):
    rows = _leader_signals(spark, sf).where(F.col("group").isin("S1", "S3")).withColumn("after", F.col("group") == "S1")
    return rounded(st.bootstrap_difference(rows, ["leader", "horizon"], "after", "signed_atr", ["symbol", "bar_index"]))


def volatility_p_values(spark, sf):
    v = volatility_expansion(spark, sf)
    return rounded(v.withColumn("p_value", d.f_p_value(F.col("statistic"), F.lit(1.0), F.col("n_events") + F.col("n_baseline") - 2)))


def plateau_p_values(spark, sf):
    near = grid.neighbours(grid.grid_frame(spark, _grid()))
    return rounded(grid.plateau_p_values(grid.plateau(grid.scores(grid.ranked(_cells(spark, sf))), near)))


def _prices(spark, sf):
    """Written once, as each check reads them several times."""
    return kept(bars2(spark, sf).select(*AT, "open", "high", "low", "close"), "prices")


def causality_check(spark, sf):
    """Features that change when later bars are cut: none."""
    bars = _prices(spark, sf)
    cuts = causality.series_cuts(bars, 102)
    out = None
    for f in causality.together({"squeeze": ind.squeeze, "wavetrend": ind.wavetrend, "adx": ind.adx}):
        # rows that differ are those of all builders that share a pass
        name, rows = F.split("column", "/"), F.col("column") == causality.ROWS
        found = causality.differences(f, bars, cuts).select(F.when(rows, F.lit(", ".join(f.names))).otherwise(name[0]).alias("builder"), F.when(rows, F.col("column")).otherwise(F.element_at(name, -1)).alias("column"), "changed")
        out = found if out is None else out.union(found)
    return out.groupBy("builder", "column").agg(F.sum("changed").alias("changed"))


def negative_controls(spark, sf):
    """Builders that look ahead, and at how many cuts of all series the checker catches them."""
    bars = _prices(spark, sf)
    cuts = causality.series_cuts(bars)
    out = None
    for f in causality.together(causality.NEGATIVE_CONTROLS):
        found = causality.differences(f, bars, cuts).select(F.split_part("column", F.lit("/"), F.lit(1)).alias("builder"), "symbol", "cut")
        out = found if out is None else out.union(found)
    return out.groupBy("builder").agg(F.count_distinct("symbol", "cut").alias("caught_cuts"))


#: Edges of half-open periods, within the line items' dates.
EDGES = ("1992-01-01", "1994-07-01", "1997-01-01", "1999-01-01")
BY_HORIZON = {h: f"h{h}" for h in HORIZONS}
TESTED_CELLS = 18


def period_edges(spark, sf):
    """Moments of the events in each half-open period."""
    rows = _events(spark, sf).withColumn("period", reports.period_of(F.col("close_time"), list(EDGES))).where("period is not null")
    return _moments(rows, ["period", "horizon"], "signed_bps")


def overlapping_periods(spark, sf):
    """Moments of the events in each two years that begin with a year of the table: every event is in two of them."""
    years = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.year("l_shipdate").alias("y")).where("y is not null").distinct()
    periods = years.selectExpr("concat(y, '+2') as period", "cast(make_date(y, 1, 1) as timestamp) as begin", "cast(make_date(y + 2, 1, 1) as timestamp) as end")
    return _moments(reports.in_periods(_events(spark, sf), periods, "close_time"), ["period", "horizon"], "signed_bps")


def _judged(spark, sf):
    cells = st.with_p_value(st.summary(_events(spark, sf), ["interval", "horizon"], "signed_bps"))
    low = F.col("mean") - 2 * F.col("stderr")
    return reports.passing(cells, significant=F.col("p_value") < 0.05 / TESTED_CELLS, above_cost=F.col("mean") > COSTS_BPS[0], low_above_cost=low > COSTS_BPS[0])


def passing_cells(spark, sf):
    return rounded(_judged(spark, sf).select("interval", "horizon", "n", "mean", "significant", "above_cost", "low_above_cost", "passes"))


def pass_counts(spark, sf):
    return reports.pass_counts(_judged(spark, sf), ["interval"], ["significant", "above_cost", "low_above_cost"])


def definition_pivot(spark, sf):
    """Events of each definition: rows of (symbol, definition), turned to one row a symbol."""
    counts = release_definitions(spark, sf)
    tall = counts.select("symbol", F.expr("stack(3, 'any', `any`, 'gray', gray, 'blue', blue) as (definition, n_events)"))
    return reports.pivoted(tall, ["symbol"], "definition", {x: f"n_{x}" for x in ("any", "gray", "blue")}, F.sum("n_events"))


def symbol_pivot(spark, sf):
    return rounded(reports.pivoted(_events(spark, sf), ["symbol"], "horizon", BY_HORIZON, F.avg("signed_bps")))


def grid_pivot(spark, sf):
    """Mean returns of each setting by horizon, beside the setting's label."""
    wide = reports.pivoted(_cells(spark, sf), ["setting_key"], "horizon", BY_HORIZON, F.max("mean_atr"))
    labels = grid.grid_frame(spark, _grid()).select("setting_key", "label")
    return rounded(labels.join(wide, "setting_key", "left"))


def grid_blue_bars(spark, sf):
    """The most bars in neither state of each squeeze label, over the intervals."""
    return grid.blue_bars(bars2(spark, sf), _grid()).groupBy("label").agg(F.max("blue_bars").alias("blue_bars"))


def grid_symbol_means(spark, sf):
    mean = F.try_divide(F.sum("sa"), F.sum("n"))  # of the intervals, of which there is one
    return rounded(reports.pivoted(_symbol_sums(spark, sf), ["setting_key", "horizon"], "symbol", {x: f"mean_atr_{x}" for x in ("A", "N", "R")}, mean))


def result_identity(spark, sf):
    """Whether the cells of two release definitions are the same, as they are where no bar is in neither state.

    One task sums a bar's return for both definitions, and cells are summed once, so that the same events give the same doubles in whatever order they come.
    """
    rows = events.defined(_study(spark, sf), ("any", "gray")).where(F.col("signed_bps").isNotNull())
    by, x = ["interval", "horizon"], F.col("signed_bps")
    of = {f"{n}_{d}": f(F.when(F.col(d), x)) for d in ("any", "gray") for n, f in (("mean", F.avg), ("std", F.stddev_samp))}
    cells = kept(rows.groupBy(*by).agg(*[c.alias(n) for n, c in of.items()]), "cells")
    one = lambda d: cells.where(F.col(f"mean_{d}").isNotNull()).select(*by, F.col(f"mean_{d}").alias("mean"), F.col(f"std_{d}").alias("std"))
    return reports.same_results(one("any"), one("gray"), by, ["mean", "std"])


def selection_lists(spark, sf):
    keep = ["setting_key", "interval", "score", "score_percentile", "neighbour_percentile", "best_horizon", "mean_atr", "mean_bps", "n_signals", "passes_neighbour", "passes_signs", "passes_all"]
    return reports.selection_lists(grid_selection(spark, sf).select(*keep))


def three_way(spark, sf):
    """Groups S1, S2 and S3 of each leader in one row, and Welch's test of S1 against S3."""
    return rounded(reports.three_way(_leader_signals(spark, sf), ["leader", "horizon"]))


def group_counts(spark, sf):
    rows = _leader_signals(spark, sf).where(F.col("horizon") == HORIZONS[0])
    return rows.groupBy("leader", "symbol").agg(*[F.count_if(F.col("group") == g).alias(f"n_{g}") for g in reports.GROUPS])


def leader_symbols(spark, sf):
    """Mean of each symbol beside each other."""
    return rounded(reports.pivoted(_leader_signals(spark, sf), ["leader", "horizon"], "symbol", {x: f"mean_atr_{x}" for x in ("A", "N", "R")}, F.avg("signed_atr")))


def scrutiny(spark, sf):
    """What each part of a scrutiny says: part, key, horizon, n, mean, t_stat."""
    parts = studies.scrutiny(_events(spark, sf), edges=list(EDGES))
    keys = {"per_symbol": "symbol", "leave_one_out": "excluded", "halves": "half", "periods": "period", "horizons": None, "thinned": None}
    out = None
    for name, key in keys.items():
        part = parts[name].select(F.lit(name).alias("part"), (F.col(key).cast("string") if key else F.lit("all")).alias("key"), "horizon", "n", "mean", "t_stat")
        out = part if out is None else out.union(part)
    return rounded(out)


_ALL = (
    bars_rows2, bars_daily, bars_events_4h, integrity_report, missing_times, missing_pattern, spacing_faults, true_range, bollinger, keltner, squeeze_states, squeeze_run,
    color_state, linreg_momentum, val_norm, state_structure, ema, wilder, wavetrend, adx, zero_divisions, forward_returns, release_events, baseline_bars, bar_move,
    release_definitions, event_totals, direction_summary, direction_accel, per_symbol, leave_one_out, period_split, baseline_direction, run_buckets, hour_of_day, volatility_expansion,
    leader_signals, leader_secondary, leader_summary, leader_groups, group_difference, non_overlap, grid_settings, grid_neighbours, grid_cells, grid_scores, grid_selection,
    plateau, bar_ranks, part_b, confirmation_table, quarterly_stability, cost_matrix, p_values, bootstrap_ci, bootstrap_diff, volatility_p_values, plateau_p_values, causality_check, negative_controls,
    period_edges, overlapping_periods, passing_cells, pass_counts, definition_pivot, symbol_pivot, grid_pivot, grid_blue_bars, grid_symbol_means, result_identity, selection_lists, three_way, group_counts, leader_symbols, scrutiny,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The event study's direction cells: bars, channels, releases, returns and their moments."""
    return direction_summary(spark, sf)
