"""Targets, release events, baselines and leader signals: sparse long tables with returns by horizon."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions import selection
from tidebar.functions import series as s
from tidebar.operators.indicators import adx, adx_lines, adx_lookback, squeeze, squeeze_lines, true, wavetrend, wavetrend_lines, wavetrend_lookback
from tidebar.params import COSTS_BPS, HORIZONS, LOOKBACKS, WARMUP_LEADER, AdxParams, SqueezeParams, WaveTrendParams

DEFINITIONS = ("gray", "blue", "any")
LEADERS = ("wavetrend", "adx")
VARIANTS = ("primary", "secondary")


def with_targets(bars: DataFrame, horizons=HORIZONS, atr: str | None = "atr_norm", chunk_bars: int = s.CHUNK_BARS) -> DataFrame:
    """ret_{N}_bps and, where bars have atr, ret_{N}_atr: in at the next bar's open, out at the close N bars on; null at the end."""
    df = with_exits(s.spread(bars, 0, max(horizons) + 1, chunk_bars), horizons)
    return s.gathered(returns(df, horizons, atr), bars)


def with_exits(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Spread bars with _entry, the next bar's open, and _exit_{N}, the close N bars on."""
    w = s.over(df)
    return df.withColumns({"_entry": F.lead("open", 1).over(w), **{f"_exit_{h}": F.lead("close", h).over(w) for h in horizons}})


def returns(df: DataFrame, horizons=HORIZONS, atr: str | None = "atr_norm") -> DataFrame:
    """What with_targets makes of the exits."""
    made = {}
    for h in horizons:
        made[f"ret_{h}_bps"] = (F.try_divide(F.col(f"_exit_{h}"), F.col("_entry")) - 1.0) * 10_000.0
        if atr:
            made[f"ret_{h}_atr"] = F.try_divide(F.col(f"_exit_{h}") - F.col("_entry"), F.col(atr))
    return df.withColumns(made).drop("_entry", *(f"_exit_{h}" for h in horizons))


def long(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Wide targets as rows: horizon, ret_bps, ret_atr. Done after filters, as it multiplies rows."""
    rest = [c for c in df.columns if not (c.startswith("ret_") and c.endswith(("_bps", "_atr")))]
    stacked = ", ".join(f"{h}, ret_{h}_bps, ret_{h}_atr" for h in horizons)
    return df.selectExpr(*(f"`{c}`" for c in rest), f"stack({len(horizons)}, {stacked}) as (horizon, ret_bps, ret_atr)")


def is_release(definition: str) -> Column:
    """gray: the squeeze gives way to its opposite; blue: to neither state; any: either."""
    if definition not in DEFINITIONS:
        raise ValueError(f"unknown definition {definition}")
    return {"gray": F.col("released"), "blue": F.col("became_blue"), "any": F.col("released") | F.col("became_blue")}[definition]


def val_sign() -> Column:
    """-1 below zero, else 1; null where val is."""
    return F.when(F.col("val") < 0, -1.0).when(F.col("val").isNotNull(), 1.0)


def studied(bars: DataFrame, params: SqueezeParams | None = None, horizons=HORIZONS, runs: bool = True, chunk_bars: int = s.CHUNK_BARS) -> DataFrame:
    """Bars with indicators, targets, (runs) the run before the bar, and whether the study counts them (valid). Chunks are made once, for what looks back and ahead."""
    p = params or SqueezeParams()
    df = s.spread(bars, p.lookback, max(horizons) + 1, chunk_bars)
    df = s.gathered(returns(squeeze(with_exits(df, horizons), p, runs=False), horizons))
    if runs:
        df = s.run_length(df, "sqz_on", "squeeze_run", chunk_bars).withColumnRenamed("squeeze_run_before", "run_before")
    valid = (F.col("bar_index") >= p.warmup) & F.col("val").isNotNull() & F.col("atr_norm").isNotNull()
    return df.withColumns({"val_sign": val_sign(), "valid": valid})


_EVENT = ("symbol", "interval", "bar_index", "close_time", "run_before", "val", "val_norm", "val_sign", "val_rising")


def events(study: DataFrame, definition: str = "gray", horizons=HORIZONS) -> DataFrame:
    """Release events by horizon; signed: the return in the direction of val."""
    rows = study.where(F.col("valid") & is_release(definition))
    wide = rows.select(*(c for c in _EVENT if c in study.columns), *(f"ret_{h}_{u}" for h in horizons for u in ("bps", "atr")))
    return long(wide, horizons).withColumns({"definition": F.lit(definition), "signed_bps": F.col("ret_bps") * F.col("val_sign"), "signed_atr": F.col("ret_atr") * F.col("val_sign"), "utc_hour": F.hour("close_time")})


def defined(study: DataFrame, definitions: tuple[str, ...] = DEFINITIONS, horizons=HORIZONS) -> DataFrame:
    """The events of any of the definitions by horizon, once each, with a flag for each definition."""
    flags = {d: F.coalesce(is_release(d), F.lit(False)) for d in definitions}
    rows = study.where("valid").withColumns(flags).where(" or ".join(definitions))
    wide = rows.select("symbol", "interval", "bar_index", "val_sign", *definitions, *(f"ret_{h}_{u}" for h in horizons for u in ("bps", "atr")))
    return long(wide, horizons).withColumn("signed_bps", F.col("ret_bps") * F.col("val_sign"))


def baseline(study: DataFrame, horizons=HORIZONS, more: tuple[str, ...] = ()) -> DataFrame:
    """All counted bars by horizon, events among them, with more columns of theirs."""
    wide = study.where("valid").select("symbol", "interval", "bar_index", "val", "val_sign", *more, *(f"ret_{h}_{u}" for h in horizons for u in ("bps", "atr")))
    return long(wide, horizons).withColumn("signed_bps", F.col("ret_bps") * F.col("val_sign"))


def bar_move(bars: DataFrame) -> DataFrame:
    """Median absolute one-bar move of each series, in basis points."""
    near = s.spread(bars.select("symbol", "interval", s.ORDER, "close"), 1)
    before = F.lag("close", 1).over(s.over(near))
    moves = s.gathered(near.withColumn("move", F.abs(F.col("close") / before - 1) * 10_000))
    by = ["symbol", "interval"]
    middle = selection.medians(moves, by, F.col("move")).select(*by, F.col("median").alias("bar_move_bps"))
    return selection.met(moves.select(*by).distinct(), middle, by, "left")


def totals(study: DataFrame, definition: str = "gray", costs: tuple[float, ...] = COSTS_BPS) -> DataFrame:
    """Of each series: its events, its counted bars, its median one-bar move, and that as a multiple of each cost."""
    by = ["symbol", "interval"]
    released = F.count_if(F.col("valid") & is_release(definition))
    counts = study.groupBy(*by).agg(released.alias("n_events"), F.count_if("valid").alias("n_bars"))
    moved = selection.met(counts, bar_move(study), by)
    return moved.withColumns({f"move_over_{str(c).replace('.', '_')}": F.try_divide("bar_move_bps", F.lit(c)) for c in costs})


def recent(df: DataFrame, flag: str, k: int) -> Column:
    """Whether the flag held in the last k bars, as far as there are."""
    return F.max(F.col(flag).cast("int")).over(s.last(df, k)) == 1


def leader_bars(bars: DataFrame, leader: str, squeeze_params: SqueezeParams | None = None, wt: WaveTrendParams | None = None, dx: AdxParams | None = None) -> DataFrame:
    """Bars with the leader's primary and secondary signals and direction, squeeze states and targets."""
    p = squeeze_params or SqueezeParams()
    base = s.spread(bars, p.lookback + max(LOOKBACKS), max(HORIZONS) + 1)
    base = with_targets(squeeze(base, p, runs=False))
    base = s.gathered(base.withColumns({f"recent_release_{k}": recent(base, "released", k) for k in LOOKBACKS}))
    if leader == "wavetrend":
        p = wt or WaveTrendParams()
        df = wavetrend(base, p)
        zone = (F.col("cross_up") & true(F.col("wt1") < p.oversold)) | (F.col("cross_down") & true(F.col("wt1") > p.overbought))
        return df.withColumns({"primary": F.col("cross_up") | F.col("cross_down"), "secondary": zone, "direction": F.when(F.col("cross_up"), 1.0).otherwise(-1.0)})
    if leader == "adx":
        df = adx(base, dx)
        return df.withColumns({"primary": F.col("cross_threshold"), "secondary": F.col("cross_secondary"), "direction": F.when(F.col("bullish"), 1.0).otherwise(-1.0)})
    raise ValueError(f"unknown leader {leader}")


def group_of(k: int = 6) -> Column:
    """S1: a release within k bars; S2: in a squeeze; S3: else."""
    return F.when(F.col(f"recent_release_{k}"), "S1").when(F.col("sqz_on"), "S2").otherwise("S3")


def signals(led: DataFrame, leader: str, variant: str = "primary", k: int = 6, warmup: int = WARMUP_LEADER) -> DataFrame:
    """A leader's signals by horizon, signed by direction."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    rows = led.where((F.col("bar_index") >= warmup) & F.col("atr_norm").isNotNull() & F.col(variant))
    wide = rows.select(F.lit(leader).alias("leader"), F.lit(variant).alias("variant"), "symbol", "interval", "bar_index", "close_time", "direction", "secondary", "sqz_on", *(f"recent_release_{x}" for x in LOOKBACKS), group_of(k).alias("group"), *(f"ret_{h}_{u}" for h in HORIZONS for u in ("bps", "atr")))
    return long(wide).withColumns({"signed_bps": F.col("ret_bps") * F.col("direction"), "signed_atr": F.col("ret_atr") * F.col("direction")})


def leader_signals(bars: DataFrame, variant: str = "primary", k: int = 6, params: SqueezeParams | None = None, warmup: int = WARMUP_LEADER, chunk_bars: int = s.CHUNK_BARS) -> DataFrame:
    """signals of both leaders over their leader_bars, by one pass: chunks are made once, for what windows and lines look back and ahead, and only signals leave the task that finds them."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    p, wt, dx = params or SqueezeParams(), WaveTrendParams(), AdxParams()
    near = s.spread(bars, max(p.lookback + max(LOOKBACKS), wavetrend_lookback(wt), adx_lookback(dx)), max(HORIZONS) + 1, chunk_bars)
    near = with_exits(near)
    rest = ["symbol", "interval", "bar_index", "close_time", "_entry", *(f"_exit_{h}" for h in HORIZONS)]
    near = near.select("chunk", "own", "open", "high", "low", "close", *rest)
    flags = ["secondary", "sqz_on", *(f"recent_release_{x}" for x in LOOKBACKS)]
    kinds = {"leader": T.StringType(), "direction": T.DoubleType(), "atr_norm": T.DoubleType(), **{c: T.BooleanType() for c in flags}}
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()] + [T.StructField(f.name, f.dataType) for f in near.select(*rest).schema])

    def found(part: pa.Table) -> pa.Table:
        part = s.ordered(part)
        b = s.prices(part)
        w, a, q = wavetrend_lines(b, wt), adx_lines(b, dx), squeeze_lines(b, p, colors=False)
        counted = part["own"].to_numpy() & (part["bar_index"].to_numpy() >= warmup) & ~np.isnan(q["atr_norm"])
        released = np.concatenate([[0], np.cumsum(q["released"])])
        end = np.arange(1, len(b) + 1)
        near_release = [released[end] > released[np.maximum(end - x, 0)] for x in LOOKBACKS]
        zone = (w["cross_up"] & w["oversold_zone"]) | (w["cross_down"] & w["overbought_zone"])
        out = []
        for name, primary, second, up in (("wavetrend", w["cross_up"] | w["cross_down"], zone, w["cross_up"]), ("adx", a["cross_threshold"], a["cross_secondary"], a["bullish"])):
            second, up = second.to_numpy(dtype=bool), up.to_numpy(dtype=bool)
            at = np.flatnonzero((primary.to_numpy(dtype=bool) if variant == "primary" else second) & counted)
            own = [pa.array([name] * len(at), pa.string()), pa.array(np.where(up[at], 1.0, -1.0)), *(pa.array(x[at]) for x in (q["atr_norm"], second, q["sqz_on"], *near_release))]
            out.append(pa.table([*own, *part.select(rest).take(pa.array(at)).columns], names=schema.names))
        return pa.concat_tables(out)

    rows = returns(near.groupBy(*s.keys(near)).applyInArrow(found, schema)).withColumns({"variant": F.lit(variant), "group": group_of(k)})
    return long(rows).withColumns({"signed_bps": F.col("ret_bps") * F.col("direction"), "signed_atr": F.col("ret_atr") * F.col("direction")})
