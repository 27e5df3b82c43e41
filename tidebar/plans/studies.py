"""Whole studies: from bars to written result tables.

Each takes bars with any number of symbols and intervals and makes one plan for
all of them; the bars with indicators and targets are written once by the
caller's choice (see `stored`) and every table reads them from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions import selection
from tidebar.functions.shared import kept
from tidebar.operators import events, grid, reports
from tidebar.operators import statistics as st
from tidebar.params import HORIZONS, LOOKBACKS, MIN_SAMPLE, RUN_BUCKETS, SqueezeParams
from tidebar.sources import sinks
from tidebar.sources.bars import numbered


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet by series, so that later scans read only the series they need."""
    df.write.mode("overwrite").partitionBy("symbol", "interval").parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class EventStudy:
    direction: DataFrame
    baseline_direction: DataFrame
    volatility: DataFrame
    run_buckets: DataFrame
    hour_of_day: DataFrame
    per_symbol: DataFrame
    definitions: DataFrame

    def write(self, out: str) -> None:
        for name, df in vars(self).items():
            sinks.write_csv(df, f"{out}/{name}")


def tested(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Moments, p-value, block-bootstrap interval and the t of the thinned sample."""
    cells = st.with_p_value(st.summary(df, by, value))
    interval = st.bootstrap(df, by, value, ["symbol", "bar_index"]).select(*by, "ci_low", "ci_high")
    alone = [*by, *(c for c in ("symbol",) if c not in by)]
    thin = st.non_overlapping(df.where(F.col(value).isNotNull()), [c for c in alone if c != "horizon"])
    thinned = st.with_p_value(st.summary(thin, by, value)).select(*by, F.col("n").alias("n_thinned"), F.col("t_stat").alias("t_thinned"), F.col("p_value").alias("p_thinned"))
    return cells.join(interval, by).join(thinned, by, "left")


def event_study(study: DataFrame, definition: str = "gray", horizons=HORIZONS) -> EventStudy:
    """study: events.studied(bars), stored."""
    ev, base = events.events(study, definition, horizons), events.baseline(study, horizons)
    cell = ["interval", "horizon"]
    both = ev.select(*cell, "ret_bps", F.lit(True).alias("event")).union(base.select(*cell, "ret_bps", F.lit(False).alias("event")))
    buckets = ev.withColumn("min_run", F.explode(F.array_compact(F.array(*[F.when(F.col("run_before") >= m, F.lit(m)) for m in RUN_BUCKETS]))))
    hour = [*cell, "utc_hour"]
    hours = ev.groupBy(*hour).agg(F.count("*").alias("size"), F.avg("signed_bps").alias("mean_bps"))
    hours = selection.met(hours, selection.medians(ev, hour, F.abs("ret_bps")).select(*hour, F.col("median").alias("median_abs_bps")), hour, "left")
    return EventStudy(
        tested(ev, cell, "signed_bps"),
        st.with_p_value(st.summary(base, cell, "signed_bps")),
        st.brown_forsythe(both, cell, F.col("event"), "ret_bps"),
        st.with_p_value(st.summary(buckets, [*cell, "min_run"], "signed_bps")).where("n >= 2"),
        hours,
        st.with_p_value(st.summary(ev, ["symbol", *cell], "signed_bps")),
        study.where("valid").groupBy("symbol", "interval").agg(*[F.count_if(events.is_release(x)).alias(x) for x in events.DEFINITIONS]),
    )


def leader_study(bars: DataFrame, variant: str = "primary", k: int = 6, params: SqueezeParams | None = None) -> DataFrame:
    """Cells of both leaders: ATR units tested, basis points beside them."""
    by = ["leader", "interval", "horizon"]
    rows = events.leader_signals(bars, variant, k, params).where(F.col("signed_atr").isNotNull())
    agree = rows.groupBy(*by, "symbol").agg(F.avg("signed_atr").alias("m")).groupBy(*by).agg(st.signs_agree(F.col("m")).alias("signs_agree"))
    return tested(rows, by, "signed_atr").join(rows.groupBy(*by).agg(F.avg("signed_bps").alias("mean_bps")), by).join(agree, by)


def lookback_table(led: DataFrame, leader: str) -> DataFrame:
    """Groups by each look-back, one of which decides and the others describe."""
    out = None
    for k in LOOKBACKS:
        part = st.summary(events.signals(led, leader, "primary", k), ["group", "horizon"], "signed_atr").withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class GridSearch:
    cells: DataFrame
    breakdown: DataFrame
    plateau: DataFrame


def grid_search(spark: SparkSession, bars: DataFrame, settings: list[grid.Setting] | None = None) -> GridSearch:
    """All settings over all series in one plan; ranks, scores, neighbours and the surfaces' smoothness."""
    settings = settings or grid.build_grid()
    ranked = grid.ranked(grid.pooled(grid.symbol_sums(grid.context_of(bars), settings)))
    near = grid.neighbours(grid.grid_frame(spark, settings))
    return GridSearch(ranked, grid.selection(ranked, near), grid.plateau_p_values(grid.plateau(grid.scores(ranked), near)))


def confirm(bars: DataFrame, candidates: list[dict], alpha: float = 0.05, cost_bps: float = 1.0) -> DataFrame:
    """Registered candidates on bars they weren't chosen on: a candidate passes where p, interval and signs all allow."""
    settings = grid.build_grid()
    chosen = [grid.setting_of(c, settings) for c in candidates]
    spark = bars.sparkSession
    needed = bars.where(F.col("interval").isin(sorted({c["interval"] for c in candidates})))
    signals = grid.grid_signals(grid.context_of(needed), chosen)
    registered = spark.createDataFrame([(s.key, c["interval"], c["horizon"], float(c["part_a_mean_atr"])) for s, c in zip(chosen, candidates, strict=True)], "setting_key string, interval string, horizon int, part_a_mean_atr double")
    by = ["setting_key", "interval", "horizon"]
    cells = st.with_p_value(grid.confirmation(signals))
    interval = st.bootstrap(signals, by, "signed_bps", ["symbol", "bar_index"]).select(*by, "ci_low", "ci_high")
    out = cells.join(interval, by, "left").join(F.broadcast(registered), by, "left").withColumn("registered", F.col("part_a_mean_atr").isNotNull())
    passes = (F.col("p_value") < alpha / max(1, len(candidates))) & (F.col("ci_low") > cost_bps) & F.col("signs_agree")
    return out.withColumns({"retention": F.try_divide("mean_atr", "part_a_mean_atr"), "passes": F.coalesce(F.col("registered") & passes, F.lit(False))})


def confirmation_table(signals: DataFrame) -> DataFrame:
    """One row for each setting, interval and horizon: moments, median, test and interval in ATR units, mean and interval in basis points, agreement of the three symbols, and the thinned sample.

    Cells of fewer than MIN_SAMPLE signals have a short row: their number, no signs that agree, and nulls. The signals are written once.
    """
    by = ["setting_key", "interval", "horizon"]
    rows = kept(signals.where(F.col("signed_atr").isNotNull()).select(*by, "symbol", "bar_index", "signed_atr", "signed_bps"), "confirmation")
    order = ["symbol", "bar_index"]
    names = {"mean": "mean_atr", "std": "std_atr", "median": "median_atr", "t_stat": "t_stat", "p_value": "p_value", "win_rate": "win_rate"}
    cells = st.with_p_value(st.summary(rows, by, "signed_atr")).select(*by, "n", *[F.col(a).alias(b) for a, b in names.items()])
    ends = lambda value, unit: st.bootstrap(rows, by, value, order).select(*by, F.col("ci_low").alias(f"ci_low_{unit}"), F.col("ci_high").alias(f"ci_high_{unit}"))
    thin = st.non_overlapping(rows, ["setting_key", "interval", "symbol"])
    thinned = st.with_p_value(st.summary(thin, by, "signed_atr")).select(*by, F.col("n").alias("n_thinned"), F.col("mean").alias("mean_thinned"), F.col("p_value").alias("p_thinned"))
    means = rows.groupBy(*by, "symbol").agg(F.avg("signed_atr").alias("m"), F.sum("signed_bps").alias("s"), F.count("signed_bps").alias("k"))
    agree = means.groupBy(*by).agg(st.signs_agree(F.col("m"), 3).alias("signs_agree"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean_bps"))
    for part in (agree, ends("signed_atr", "atr"), ends("signed_bps", "bps"), thinned):
        cells = selection.met(cells, part, by, "left")
    enough = F.col("n") >= MIN_SAMPLE
    return cells.select(*by, "n", (enough & F.col("signs_agree")).alias("signs_agree"), *[F.when(enough, F.col(c)).alias(c) for c in cells.columns if c not in (*by, "n", "signs_agree")])


def without_each(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """excluded, by, n, mean, t_stat: moments of all symbols but one, from each symbol's own sums, subtracted from all; "none" excludes none."""
    x = F.col(value)
    each = rows.where(x.isNotNull()).groupBy("symbol", *by).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    total = each.groupBy(*by).agg(*[F.sum(c).alias(f"all_{c}") for c in "nsq"])
    left = each.join(total, by).select(F.col("symbol").alias("excluded"), *by, *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in "nsq"])
    left = left.unionByName(total.select(F.lit("none").alias("excluded"), *by, *[F.col(f"all_{c}").alias(c) for c in "nsq"])).where("n > 0")
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.try_divide(F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0)), F.nullif(F.col("n") - 1, F.lit(0))))
    return left.select("excluded", *by, "n", mean.alias("mean"), F.try_divide(mean, deviation / F.sqrt("n")).alias("t_stat"))


#: Bars of a piece that rows are numbered in.
HALF_PIECE = 1 << 16


def scrutiny(rows: DataFrame, value: str = "signed_bps", edges: list[str] | None = None, time: str = "close_time") -> dict[str, DataFrame]:
    """What a passing cell must bear: symbols alone, each left out, halves and periods, all horizons, and the thinned sample.

    Serves events, leaders' signals and settings' signals alike: rows have symbol, horizon, bar_index and the value.
    They are written once, and all parts read them there; the earlier half of a series has the odd row.
    """
    rows = kept(rows.select("symbol", "horizon", "bar_index", value, *([time] if edges else [])), "scrutiny")
    series = ["symbol", "horizon"]
    sizes = rows.groupBy(*series).agg(F.count("*").alias("_rows"))
    halves = selection.met(numbered(rows, series, ["bar_index"], [f"bar_index div {HALF_PIECE}"]), sizes, series)
    halves = halves.withColumn("half", F.when(F.col("rn") * 2 < F.col("_rows"), 1).otherwise(2))
    return {
        "per_symbol": st.summary(rows, ["symbol", "horizon"], value),
        "leave_one_out": without_each(rows, ["horizon"], value),
        "horizons": st.summary(rows, ["horizon"], value),
        "halves": st.summary(halves, ["half", "horizon"], value),
        **({"periods": st.summary(rows.withColumn("period", reports.period_of(F.col(time), edges)).where("period is not null"), ["period", "horizon"], value)} if edges else {}),
        "thinned": st.summary(st.non_overlapping(rows.where(F.col(value).isNotNull()), ["symbol"]), ["horizon"], value),
    }
