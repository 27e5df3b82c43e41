"""DuckDB SQL of the queries, composed of common table expressions."""

from __future__ import annotations

from tidebar.operators.grid import Setting, build_grid
from tidebar.params import COSTS_BPS, HORIZONS, RUN_BUCKETS
from tidebar.queries import BY_HORIZON, CONFIRMED, EDGES, PARTS, TESTED_CELLS

WIN = "PARTITION BY symbol ORDER BY bar_index"
ORDER = "l_shipdate, l_orderkey, l_linenumber, l_extendedprice"


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


def many(*names: str) -> str:
    return ", ".join(r6(n) for n in names)


def rows_bars(rows: int = 2) -> str:
    return f"""ticks AS (SELECT l_returnflag AS symbol, row_number() OVER (PARTITION BY l_returnflag ORDER BY {ORDER}) - 1 AS rn, l_extendedprice AS price, l_quantity AS qty, l_shipdate AS t FROM lineitem),
bars AS MATERIALIZED (SELECT symbol, '{rows}r' AS interval, CAST(rn // {rows} AS BIGINT) AS bar_index, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, sum(qty) AS volume, max(t) AS close_time
  FROM ticks GROUP BY symbol, rn // {rows} HAVING count(*) = {rows})"""


def time_bars(source: str, symbol: str, time: str, price: str, volume: str, key: str, minutes: int, name: str, out: str) -> str:
    step = minutes * 60
    return f"""{out}0 AS (SELECT {symbol} AS symbol, make_timestamp(CAST(floor(epoch({time})) AS BIGINT) // {step} * {step} * 1000000) AS open_time, {price} AS price, {volume} AS qty, {key} AS k FROM {source}),
{out} AS MATERIALIZED (SELECT symbol, '{name}' AS interval, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS bar_index, open_time, open_time + INTERVAL {minutes} MINUTE - INTERVAL 1 MILLISECOND AS close_time, open, high, low, close, volume, n AS count
  FROM (SELECT symbol, open_time, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(qty) AS volume, count(*) AS n FROM {out}0 GROUP BY ALL))"""


DAILY = time_bars("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity", "{'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice}", 1440, "1d", "daily")
EVENTS_4H = time_bars("events", "event_type", "ts", "value", "1.0::DOUBLE", "{'a': ts, 'b': event_id}", 240, "4h", "four")
EVENTS_1H = time_bars("events", "event_type", "ts", "value", "1.0::DOUBLE", "{'a': ts, 'b': event_id}", 60, "1h", "hourly")


def over(n: int) -> str:
    return f"OVER ({WIN} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(f: str, n: int, first: int = 0) -> str:
    """f over n bars where there are so many from the first one that has a value."""
    return f"CASE WHEN bar_index >= {first + n - 1} THEN {f} {over(n)} END"


def squeeze(kc_mult: float, bb: int = 20, kc: int = 20, bb_mult: float = 2.0, n: int = 20, source: str = "bars", pre: str = "") -> str:
    return f"""{pre}s1 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({WIN})), abs(low - lag(close) OVER ({WIN}))) AS true_range FROM {source}),
{pre}s2 AS (SELECT *, {full('avg(close)', bb)} AS basis, {full('stddev_pop(close)', bb)} * {bb_mult} AS dev, {full('avg(close)', kc)} AS kc_ma, {full('avg(true_range)', kc)} AS rangema, {full('avg(true_range)', 100)} AS atr_norm,
  close - (({full('max(high)', n)} + {full('min(low)', n)}) / 2 + {full('avg(close)', n)}) / 2 AS delta FROM {pre}s1),
{pre}s3 AS (SELECT *, basis + dev AS upper_bb, basis - dev AS lower_bb, kc_ma + rangema * {kc_mult} AS upper_kc, kc_ma - rangema * {kc_mult} AS lower_kc,
  CASE WHEN bar_index >= {2 * n - 2} THEN avg(delta) {over(n)} + regr_slope(delta, bar_index::DOUBLE) {over(n)} * {(n - 1) / 2} END AS val FROM {pre}s2),
{pre}s4 AS (SELECT *, coalesce(lower_bb > lower_kc AND upper_bb < upper_kc, false) AS sqz_on, coalesce(lower_bb < lower_kc AND upper_bb > upper_kc, false) AS sqz_off, dev IS NOT NULL AND rangema IS NOT NULL AS ready, lag(val) OVER ({WIN}) AS before FROM {pre}s3),
{pre}s5 AS (SELECT *, ready AND NOT sqz_on AND NOT sqz_off AS no_sqz, coalesce(lag(sqz_on) OVER ({WIN}), false) AS was_on, val / nullif(atr_norm, 0) AS val_norm, coalesce(val > before, false) AS val_rising,
  CASE WHEN val IS NULL OR before IS NULL THEN NULL WHEN val > 0 AND val > before THEN 'lime' WHEN val > 0 THEN 'green' WHEN val < before THEN 'red' ELSE 'maroon' END AS color_state,
  CAST(bar_index - coalesce(max(CASE WHEN NOT sqz_on THEN bar_index END) OVER ({WIN} ROWS UNBOUNDED PRECEDING), -1) AS INTEGER) AS squeeze_run FROM {pre}s4),
{pre}sq AS MATERIALIZED (SELECT *, sqz_off AND was_on AS released, no_sqz AND was_on AS became_blue, coalesce(lag(squeeze_run) OVER ({WIN}), 0) AS run_before FROM {pre}s5)"""


def targets(source: str, out: str, horizons=HORIZONS, atr: bool = True) -> str:
    entry = f"lead(open) OVER ({WIN})"
    cols = []
    for h in horizons:
        leave = f"lead(close, {h}) OVER ({WIN})"
        cols.append(f"({leave} / nullif({entry}, 0) - 1) * 10000 AS ret_{h}_bps")
        if atr:
            cols.append(f"({leave} - {entry}) / nullif(atr_norm, 0) AS ret_{h}_atr")
    return f"{out} AS MATERIALIZED (SELECT *, {', '.join(cols)} FROM {source})"


def long(horizons=HORIZONS) -> str:
    each = lambda u: ", ".join(f"ret_{h}_{u}" for h in horizons)
    return f"unnest([{', '.join(map(str, horizons))}]) AS horizon, unnest([{each('bps')}]) AS ret_bps, unnest([{each('atr')}]) AS ret_atr"


BARS = rows_bars()
SIGN = "CASE WHEN val < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
VALID = "bar_index >= 101 AND val IS NOT NULL AND atr_norm IS NOT NULL"
STUDY = f"{BARS},\n{squeeze(1.0)},\n{targets('sq', 'study')}"
EVENTS = f"""{STUDY},
ev0 AS (SELECT symbol, interval, bar_index, close_time, run_before, val, val_norm, {SIGN} AS val_sign, val_rising, {long()} FROM study WHERE {VALID} AND released),
ev AS MATERIALIZED (SELECT *, ret_bps * val_sign AS signed_bps FROM ev0)"""
BASE = f"""base0 AS (SELECT symbol, interval, bar_index, val, {SIGN} AS val_sign, {long()} FROM study WHERE {VALID}),
base AS MATERIALIZED (SELECT *, ret_bps * val_sign AS signed_bps FROM base0)"""


def summary(source: str, by: str, x: str, where: str = "true") -> str:
    return f"""SELECT {by}, count(*) AS n, {r6(f'avg({x})', 'mean')}, {r6(f'stddev_samp({x})', 'std')}, {r6(f'median({x})', 'median')}, {r6(f'stddev_samp({x}) / sqrt(count(*))', 'stderr')},
  {r6(f'avg({x}) / nullif(stddev_samp({x}) / sqrt(count(*)), 0)', 't_stat')}, {r6(f'avg(CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 'win_rate')}
FROM {source} WHERE {x} IS NOT NULL AND ({where}) GROUP BY {by}"""


def wt_lines(n1: int, n2: int, pre: str = "") -> str:
    """Recursive lines: one step a bar over all symbols."""
    a1, a2 = f"{2 / (n1 + 1)!r}::DOUBLE", f"{2 / (n2 + 1)!r}::DOUBLE"
    esa = f"(1 - {a1}) * r.esa + {a1} * p.ap"
    d = f"(1 - {a1}) * r.d + {a1} * abs(p.ap - x.esa)"
    return f"""{pre}ap AS MATERIALIZED (SELECT symbol, bar_index, (high + low + close) / 3.0::DOUBLE AS ap FROM bars),
{pre}wr AS (
  SELECT symbol, bar_index, ap, ap AS esa, 0.0::DOUBLE AS d, NULL::DOUBLE AS ci, NULL::DOUBLE AS wt1 FROM {pre}ap WHERE bar_index = 0
  UNION ALL
  SELECT z.symbol, z.bar_index, z.ap, z.esa, z.d, z.ci, CASE WHEN z.last IS NULL THEN z.ci WHEN z.ci IS NULL THEN z.last ELSE (1 - {a2}) * z.last + {a2} * z.ci END
  FROM (SELECT y.*, (y.ap - y.esa) / (0.015 * nullif(y.d, 0)) AS ci FROM (
    SELECT x.*, (1 - {a1}) * x.d0 + {a1} * abs(x.ap - x.esa) AS d FROM (
      SELECT p.symbol, p.bar_index, p.ap, {esa} AS esa, r.d AS d0, r.wt1 AS last FROM {pre}wr r JOIN {pre}ap p ON p.symbol = r.symbol AND p.bar_index = r.bar_index + 1) x) y) z
),
{pre}w1 AS (SELECT *, CASE WHEN bar_index >= 4 THEN avg(wt1) {over(4)} END AS wt2 FROM {pre}wr),
{pre}w2 AS (SELECT *, lag(wt1) OVER ({WIN}) AS b1, lag(wt2) OVER ({WIN}) AS b2 FROM {pre}w1),
{pre}wt AS MATERIALIZED (SELECT symbol, bar_index, ap AS hlc3, esa, d, ci, wt1, wt2, coalesce(wt1 > wt2 AND b1 <= b2, false) AS cross_up, coalesce(wt1 < wt2 AND b1 >= b2, false) AS cross_down, coalesce(wt1 < -53, false) AS oversold_zone, coalesce(wt1 > 53, false) AS overbought_zone FROM {pre}w2)"""


def adx_lines(n: int, pre: str = "") -> str:
    a = f"{1 / n!r}::DOUBLE"
    mix = lambda old, new: f"(1 - {a}) * {old} + {a} * {new}"
    dx = "100 * abs(100 * {p} / nullif({t}, 0) - 100 * {m} / nullif({t}, 0)) / nullif(100 * {p} / nullif({t}, 0) + 100 * {m} / nullif({t}, 0), 0)"
    return f"""{pre}dm0 AS (SELECT symbol, bar_index, greatest(high - low, abs(high - lag(close) OVER ({WIN})), abs(low - lag(close) OVER ({WIN}))) AS tr, high - lag(high) OVER ({WIN}) AS up, lag(low) OVER ({WIN}) - low AS down FROM bars),
{pre}dm AS MATERIALIZED (SELECT symbol, bar_index, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0::DOUBLE END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0::DOUBLE END AS mdm FROM {pre}dm0),
{pre}ar AS (
  SELECT symbol, bar_index, tr, pdm, mdm, tr AS st, pdm AS sp, mdm AS sm, {dx.format(p='pdm', m='mdm', t='tr')} AS dx, coalesce({dx.format(p='pdm', m='mdm', t='tr')}, 0) AS adx FROM {pre}dm WHERE bar_index = 0
  UNION ALL
  SELECT y.symbol, y.bar_index, y.tr, y.pdm, y.mdm, y.st, y.sp, y.sm, y.dx, {mix('y.last', 'coalesce(y.dx, 0)')}
  FROM (SELECT x.*, {dx.format(p='x.sp', m='x.sm', t='x.st')} AS dx FROM (
    SELECT p.symbol, p.bar_index, p.tr, p.pdm, p.mdm, {mix('r.st', 'p.tr')} AS st, {mix('r.sp', 'p.pdm')} AS sp, {mix('r.sm', 'p.mdm')} AS sm, r.adx AS last
    FROM {pre}ar r JOIN {pre}dm p ON p.symbol = r.symbol AND p.bar_index = r.bar_index + 1) x) y
),
{pre}ax AS MATERIALIZED (SELECT symbol, bar_index, tr AS true_range, pdm AS plus_dm, mdm AS minus_dm, 100 * sp / nullif(st, 0) AS plus_di, 100 * sm / nullif(st, 0) AS minus_di, dx, adx, lag(adx) OVER ({WIN}) AS before, coalesce(100 * sp / nullif(st, 0) > 100 * sm / nullif(st, 0), false) AS bullish FROM {pre}ar)"""


def smooth(alpha: float, name: str) -> str:
    a = f"{alpha!r}::DOUBLE"
    return f"""WITH RECURSIVE {BARS},
r AS (SELECT symbol, interval, bar_index, close AS y FROM bars WHERE bar_index = 0
  UNION ALL SELECT b.symbol, b.interval, b.bar_index, (1 - {a}) * r.y + {a} * b.close FROM r JOIN bars b ON b.symbol = r.symbol AND b.bar_index = r.bar_index + 1)
SELECT symbol, interval, bar_index, {r6('y', name)} FROM r"""


def _recent(k: int) -> str:
    return f"max(CASE WHEN released THEN 1 ELSE 0 END) {over(k)} = 1 AS recent_release_{k}"


LED = f"""{STUDY},
{wt_lines(10, 21)},
{adx_lines(14)},
led0 AS (SELECT *, {_recent(3)}, {_recent(6)}, {_recent(12)} FROM study),
led AS MATERIALIZED (SELECT *, CASE WHEN recent_release_6 THEN 'S1' WHEN sqz_on THEN 'S2' ELSE 'S3' END AS grp FROM led0),
both_ AS (
  SELECT 'wavetrend' AS leader, l.*, cross_up OR cross_down AS prim, (cross_up AND oversold_zone) OR (cross_down AND overbought_zone) AS sec, CASE WHEN cross_up THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS direction FROM led l JOIN wt USING (symbol, bar_index)
  UNION ALL
  SELECT 'adx', l.*, coalesce(adx > 20 AND before_ <= 20, false), coalesce(adx > 25 AND before_ <= 25, false), CASE WHEN bullish THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FROM led l JOIN (SELECT symbol, bar_index, adx, before AS before_, bullish FROM ax) USING (symbol, bar_index)
),
sig0 AS (SELECT leader, symbol, bar_index, direction, prim, sec, sqz_on, recent_release_3, recent_release_6, recent_release_12, grp, {long()} FROM both_ WHERE bar_index >= 500 AND atr_norm IS NOT NULL AND (prim OR sec)),
sig AS MATERIALIZED (SELECT *, ret_bps * direction AS signed_bps, ret_atr * direction AS signed_atr FROM sig0)"""


def _cell_signals(settings: list[Setting]) -> str:
    """CTEs and gs: setting_key, family, symbol, interval, bar_index, close_time, horizon, signed returns of the settings."""
    ctes, parts = [], []
    seen = set()
    for x in settings:
        p = x.params
        if x.family == "adx":
            pre, key = f"a{p['length']}_", ("adx", p["length"])
            if key not in seen:
                ctes.append(adx_lines(p["length"], pre))
            hit = f"coalesce(adx > {p['threshold']} AND before <= {p['threshold']}, false)"
            parts.append(f"SELECT '{x.key}' AS setting_key, 'adx' AS family, symbol, bar_index, CASE WHEN bullish THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS direction FROM {pre}ax WHERE {hit}")
        elif x.family == "wavetrend":
            pre, key = f"w{p['n1']}_{p['n2']}_", ("wt", p["n1"], p["n2"])
            if key not in seen:
                ctes.append(wt_lines(p["n1"], p["n2"], pre))
            hit = "(cross_up AND oversold_zone) OR (cross_down AND overbought_zone)" if p["mode"] == "zone" else "cross_up OR cross_down"
            parts.append(f"SELECT '{x.key}', 'wavetrend', symbol, bar_index, CASE WHEN cross_up THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FROM {pre}wt WHERE {hit}")
        else:
            pre, key = f"q{p['bb_length']}_{p['kc_length']}_{str(p['kc_mult']).replace('.', '_')}_", x.key
            ctes.append(squeeze(p["kc_mult"], p["bb_length"], p["kc_length"], pre=pre))
            parts.append(f"SELECT '{x.key}', 'squeeze', symbol, bar_index, CASE WHEN val > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FROM {pre}sq WHERE released AND val IS NOT NULL")
        seen.add(key)
    return f"""{BARS},
{squeeze(1.5, pre='dflt_')},
{targets('dflt_sq', 'context')},
{', '.join(ctes)},
hits(setting_key, family, symbol, bar_index, direction) AS ({' UNION ALL '.join(parts)}),
gs0 AS (SELECT h.setting_key, h.family, h.direction, c.symbol, c.interval, c.bar_index, c.close_time, {long()} FROM hits h JOIN context c USING (symbol, bar_index) WHERE bar_index >= 500 AND atr_norm IS NOT NULL),
gs AS MATERIALIZED (SELECT *, ret_bps * direction AS signed_bps, ret_atr * direction AS signed_atr FROM gs0)"""


GRID = build_grid()
CELLS = f"""{_cell_signals(GRID)},
each_ AS (SELECT setting_key, family, interval, horizon, symbol, count(signed_atr) AS n, sum(signed_atr) AS sa, count(signed_bps) AS nb, sum(signed_bps) AS sb, count(*) FILTER (WHERE signed_atr > 0) AS wins FROM gs GROUP BY ALL),
cells AS MATERIALIZED (SELECT setting_key, family, interval, horizon, sum(n) AS n_signals, sum(sa) / nullif(sum(n), 0) AS mean_atr, sum(sb) / nullif(sum(nb), 0) AS mean_bps, sum(wins) / nullif(sum(n), 0) AS win_rate,
  coalesce(count(DISTINCT sign(sa / nullif(n, 0))) = 1 AND count(sa / nullif(n, 0)) = 3, false) AS signs_agree FROM each_ GROUP BY ALL)"""
RANKED = f"""{CELLS},
ranked AS MATERIALIZED (SELECT *, CASE WHEN mean_atr IS NOT NULL THEN rank() OVER (PARTITION BY interval, horizon ORDER BY mean_atr DESC NULLS LAST) + (count(*) OVER (PARTITION BY interval, horizon, mean_atr) - 1) / 2.0::DOUBLE END AS rank_in_cell FROM cells),
score0 AS MATERIALIZED (SELECT setting_key, family, interval, avg(rank_in_cell) AS score FROM ranked GROUP BY ALL),
scores AS MATERIALIZED (SELECT *, CASE WHEN score IS NOT NULL THEN (rank() OVER (PARTITION BY interval ORDER BY score NULLS LAST) + (count(*) OVER (PARTITION BY interval, score) - 1) / 2.0::DOUBLE) / count(score) OVER (PARTITION BY interval) END AS score_percentile FROM score0)"""


def _grid_values() -> str:
    rows = []
    for x in GRID:
        rows.append(f"('{x.family}', '{x.label}', '{x.key}', [{', '.join(map(str, x.axis_index))}])")
    return f"grid(family, label, setting_key, axis) AS (VALUES {', '.join(rows)})"


NEAR = f"""{_grid_values()},
near AS (SELECT a.setting_key, b.setting_key AS neighbour_key FROM grid a JOIN grid b ON a.family = b.family AND list_sum(list_transform(list_zip(a.axis, b.axis), lambda p: abs(p[1] - p[2]))) = 1)"""
MEDIANS = f"""{RANKED},
{NEAR},
medians AS (SELECT n.setting_key, s.interval, count(s.score) AS n_neighbours, median(s.score) AS neighbour_median_score FROM near n JOIN scores s ON s.setting_key = n.neighbour_key GROUP BY ALL)"""


def _period(source: str, out: str) -> str:
    cases = " ".join(f"WHEN share >= {a} AND share < {b} THEN {i}" for i, (a, b) in enumerate(PARTS))
    return f"""{out}_n AS (SELECT symbol, count(*) AS bars FROM bars GROUP BY 1),
{out} AS MATERIALIZED (SELECT *, CASE {cases} END AS period FROM (SELECT s.*, s.bar_index * 100 / n.bars AS share FROM {source} s JOIN {out}_n n USING (symbol)))"""


PART_B = f"""{_cell_signals([x for x in GRID if x.key in CONFIRMED])},
{_period('gs', 'pg')}"""


def _confirmation(where: str, out: str) -> str:
    by = "setting_key, interval, horizon"
    return f"""{out}_s AS (SELECT {by}, symbol, avg(signed_atr) AS m FROM pg WHERE signed_atr IS NOT NULL AND {where} GROUP BY ALL),
{out}_a AS (SELECT {by}, coalesce(count(DISTINCT sign(m)) = 1 AND count(m) = 3, false) AS signs_agree FROM {out}_s GROUP BY ALL),
{out} AS (SELECT {by}, count(*) AS n, avg(signed_atr) AS mean_atr, avg(signed_bps) AS mean_bps, avg(signed_atr) / nullif(stddev_samp(signed_atr) / sqrt(count(*)), 0) AS t_stat, avg(CASE WHEN signed_atr > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate FROM pg WHERE signed_atr IS NOT NULL AND {where} GROUP BY ALL)"""


AT = "symbol, interval, bar_index"
DEFAULT = f"WITH {BARS},\n{squeeze(1.5)}"
MISSING = f"""WITH {EVENTS_1H},
span AS (SELECT symbol, min(open_time) AS a, max(open_time) AS b FROM hourly GROUP BY 1),
expected AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 60 MINUTE)) AS open_time FROM span),
missing AS (SELECT symbol, open_time FROM expected ANTI JOIN hourly USING (symbol, open_time))"""


def t_p(t: str, v: str) -> str:
    """Two-sided p-value of t with v degrees of freedom: Simpson's rule over the density from 0 to t."""
    v = f"({v})::DOUBLE"
    density = f"pow(1 + pow(abs({t}) * i / 4000, 2) / {v}, -({v} + 1) / 2)"
    area = f"list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density}))"
    return f"CASE WHEN {t} IS NOT NULL AND {v} > 0 THEN 1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * abs({t}) / 12000 * {area} END"


#: The look-ahead builders, over a window of what they may see.
CONTROLS = {
    "standardised": "(close - avg(close) OVER (PARTITION BY {by})) / stddev_samp(close) OVER (PARTITION BY {by})",
    "back_filled": "first_value(CASE WHEN bar_index % 50 <> 0 THEN close END IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY bar_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "next_close": "lead(close) OVER (PARTITION BY {by} ORDER BY bar_index)",
    "centred": "CASE WHEN count(close) OVER (PARTITION BY {by} ORDER BY bar_index ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 21 THEN avg(close) OVER (PARTITION BY {by} ORDER BY bar_index ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) END",
    "scaled": "(close - min(close) OVER (PARTITION BY {by})) / (max(close) OVER (PARTITION BY {by}) - min(close) OVER (PARTITION BY {by}))",
    "future_peak": "max(close) OVER (PARTITION BY {by} ORDER BY bar_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}


def _controls() -> str:
    made = lambda by: ", ".join(f"{x.format(by=by)} AS {name}" for name, x in CONTROLS.items())
    changed = lambda x: f"NOT (f.{x} IS NOT DISTINCT FROM t.{x} OR coalesce(abs(f.{x} - t.{x}) <= 1e-9 + 1e-9 * abs(t.{x}), false))"
    caught = " UNION ALL ".join(f"SELECT '{x}' AS builder, f.symbol, t.cut FROM full_ f JOIN cut_ t USING (symbol, bar_index) WHERE {changed(x)}" for x in CONTROLS)
    return f"""WITH {BARS},
ends AS (SELECT symbol, CAST(max(bar_index) AS BIGINT) AS e FROM bars GROUP BY 1 HAVING max(bar_index) > 10),
cuts AS (SELECT DISTINCT symbol, unnest(list_concat(list_concat(range(greatest(10, e - 64), e), range((10 + e) // 2, least((10 + e) // 2 + 64, e))), list_transform(range(0, 40), lambda k: 10 + (e - 11) * k // 39))) AS cut FROM ends),
full_ AS MATERIALIZED (SELECT symbol, bar_index, {made('symbol')} FROM bars),
cut_ AS MATERIALIZED (SELECT symbol, cut, bar_index, {made('symbol, cut')} FROM bars JOIN cuts USING (symbol) WHERE bar_index < cut)
SELECT builder, count(DISTINCT (symbol, cut)) AS caught_cuts FROM ({caught}) GROUP BY 1"""


def _mix(value: str, out: str) -> str:
    return f"(({value}) * 1103515245 + 12345) % 2147483647 AS {out}_a, (xor({out}_a, {out}_a >> 15) * 1588635695 + 12345) % 2147483647 AS {out}_b, xor({out}_b, {out}_b >> 13) AS {out}"


def _rounds(source: str, by: str, value: str, stream: str = "0", pre: str = "") -> str:
    """CTEs: the rounds' means of both methods (boot), of a sample in order of symbol and bar_index."""
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by.split(", "))
    of = lambda a: ", ".join(f"{a}.{c}" for c in by.split(", "))
    # a round's draws as a list, mixed step by step
    starts = "range(0, n // l + CASE WHEN n % l = 0 THEN 0 ELSE 1 END)"
    mix = ["(x * 1103515245 + 12345) % 2147483647", "(xor(x, x >> 15) * 1588635695 + 12345) % 2147483647", "xor(x, x >> 13)"]
    for step in ("u + x", *mix, "xor(x, v)", *mix, "(x * (n - l + 1)) // 2147483648"):
        starts = f"list_transform({starts}, lambda x: {step})"
    return f"""{pre}bs AS MATERIALIZED (SELECT {by}, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY symbol, bar_index) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {value} IS NOT NULL),
{pre}pre AS MATERIALIZED (SELECT {by}, n, greatest(10, CAST(round(pow(n, 1.0 / 3)) AS BIGINT)) AS l, i + 1 AS i, sum(x) OVER (PARTITION BY {by} ORDER BY i) AS s FROM {pre}bs UNION ALL SELECT {by}, n, greatest(10, CAST(round(pow(n, 1.0 / 3)) AS BIGINT)), 0, 0.0 FROM {pre}bs WHERE i = 0),
{pre}turns AS MATERIALIZED (SELECT {by}, n, l, r, {_mix(f"({stream}) + 20260908 + r", "u")}, {_mix("u + 1000000007", "v")} FROM (SELECT {by}, n, l, unnest(range(0, 10000)) AS r FROM {pre}pre WHERE i = 0 AND n >= 2 * l AND n >= 20)),
{pre}lists AS MATERIALIZED (SELECT {by}, list(s ORDER BY i) AS sl FROM {pre}pre GROUP BY {by}),
{pre}draws AS (SELECT {by}, n, l, r, n // l AS whole, {starts} AS places FROM {pre}turns),
{pre}boot AS MATERIALIZED (SELECT {of('d')}, d.r, list_sum(list_transform(places[1:whole], lambda x: sl[x + l + 1] - sl[x + 1])) / (whole * l) AS blocks, (list_sum(list_transform(places[1:whole], lambda x: sl[x + l + 1] - sl[x + 1])) + CASE WHEN n % l = 0 THEN 0 ELSE sl[places[whole + 1] + n % l + 1] - sl[places[whole + 1] + 1] END) / n AS moving FROM {pre}draws d JOIN {pre}lists z ON {on('d', 'z')})"""


def _bootstraps() -> dict[str, str]:
    ends = lambda x: f"{r6(f'quantile_cont({x}, 0.025)', 'ci_low')}, {r6(f'quantile_cont({x}, 0.975)', 'ci_high')}"
    each = " UNION ALL ".join(f"SELECT interval, horizon, '{m}' AS method, {ends(m)} FROM boot GROUP BY ALL" for m in ("blocks", "moving"))
    both = f"SELECT leader, horizon, {ends('a.blocks - b.blocks')} FROM boot a JOIN boot b USING (leader, horizon, r) WHERE a.grp = 'S1' AND b.grp = 'S3' GROUP BY ALL"
    return {
        "bootstrap_ci": f"WITH {EVENTS}, {_rounds('ev', 'interval, horizon', 'signed_bps')}, m AS (SELECT *, unnest(['blocks', 'moving']) AS method FROM (SELECT interval, horizon, count(*) AS n, {r6('avg(x)', 'mean')} FROM bs GROUP BY ALL)) SELECT m.*, ci_low, ci_high FROM m LEFT JOIN ({each}) USING (interval, horizon, method)",
        "bootstrap_diff": f"WITH RECURSIVE {LED}, s13 AS (SELECT * FROM sig WHERE prim AND grp IN ('S1', 'S3')), {_rounds('s13', 'leader, horizon, grp', 'signed_atr', "CASE WHEN grp = 'S1' THEN 0 ELSE 10000 END")}, m AS (SELECT leader, horizon, count(*) FILTER (WHERE grp = 'S1') AS n_a, count(*) FILTER (WHERE grp = 'S3') AS n_b FROM bs GROUP BY ALL) SELECT m.*, ci_low, ci_high FROM m LEFT JOIN ({both}) USING (leader, horizon)",
    }


def _confirmation_table() -> str:
    by, x = "setting_key, interval, horizon", "signed_atr"
    one, alone = "setting_key, interval, symbol, horizon", "e.setting_key = r.setting_key AND e.interval = r.interval AND e.symbol = r.symbol AND e.horizon = r.horizon"
    ends = lambda pre, unit: f"(SELECT {by}, {r6('quantile_cont(blocks, 0.025)', f'ci_low_{unit}')}, {r6('quantile_cont(blocks, 0.975)', f'ci_high_{unit}')} FROM {pre}boot GROUP BY ALL)"
    moments = lambda source, n: f"{n} AS (SELECT {by}, count(*) AS n, avg({x}) AS mean, stddev_samp({x}) AS std, median({x}) AS median, avg({x}) / nullif(stddev_samp({x}) / sqrt(count(*)), 0) AS t, avg(CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win FROM {source} GROUP BY ALL)"
    shown = {"mean_atr": "m.mean", "std_atr": "m.std", "median_atr": "m.median", "t_stat": "m.t", "p_value": t_p("m.t", "m.n - 1"), "win_rate": "m.win", "mean_bps": "mean_bps", "mean_thinned": "h.mean", "p_thinned": t_p("h.t", "h.n - 1")}
    plain = ["ci_low_atr", "ci_high_atr", "ci_low_bps", "ci_high_bps"]
    return f"""WITH RECURSIVE {PART_B}, cf AS MATERIALIZED (SELECT {by}, symbol, bar_index, signed_atr, signed_bps FROM pg WHERE signed_atr IS NOT NULL AND period >= 2),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {one} ORDER BY bar_index) AS k FROM cf),
kept AS (SELECT {one}, k, signed_atr, true AS keep, bar_index AS last FROM e WHERE k = 1
  UNION ALL SELECT e.setting_key, e.interval, e.symbol, e.horizon, e.k, e.signed_atr, e.bar_index >= r.last + e.horizon + 1, CASE WHEN e.bar_index >= r.last + e.horizon + 1 THEN e.bar_index ELSE r.last END FROM kept r JOIN e ON {alone} AND e.k = r.k + 1),
thin AS (SELECT * FROM kept WHERE keep), {moments('cf', 'm')}, {moments('thin', 'h')},
sy AS (SELECT {by}, symbol, avg(signed_atr) AS m FROM cf GROUP BY ALL), ag AS (SELECT {by}, coalesce(count(DISTINCT sign(m)) = 1 AND count(m) = 3, false) AS agree FROM sy GROUP BY ALL), bp AS (SELECT {by}, avg(signed_bps) AS mean_bps FROM cf GROUP BY ALL),
{_rounds('cf', by, 'signed_atr', pre='a_')}, {_rounds('cf', by, 'signed_bps', pre='b_')}
SELECT {by}, m.n, m.n >= 20 AND agree AS signs_agree, CASE WHEN m.n >= 20 THEN h.n END AS n_thinned, {', '.join(r6(f"CASE WHEN m.n >= 20 THEN {v} END", k) for k, v in shown.items())}, {', '.join(f"CASE WHEN m.n >= 20 THEN {c} END AS {c}" for c in plain)}
FROM m JOIN h USING ({by}) JOIN ag USING ({by}) JOIN bp USING ({by}) LEFT JOIN {ends('a_', 'atr')} USING ({by}) LEFT JOIN {ends('b_', 'bps')} USING ({by})"""


def _edge_period(time: str) -> str:
    cases = " ".join(f"WHEN {time} >= TIMESTAMP '{a}' AND {time} < TIMESTAMP '{b}' THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)))
    return f"CASE {cases} END"


def _wide(column: str, names: dict, value: str, f: str = "avg") -> str:
    quoted = lambda k: f"'{k}'" if isinstance(k, str) else str(k)
    return ", ".join(r6(f"{f}({value}) FILTER (WHERE {column} = {quoted(k)})", v) for k, v in names.items())


def _moments(part: str, key: str, source: str, where: str = "true", x: str = "signed_bps") -> str:
    by = "horizon" if key.startswith("'") else f"{key}, horizon"
    return f"SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS key, horizon, count(*) AS n, {r6(f'avg({x})', 'mean')}, {r6(f'avg({x}) / nullif(stddev_samp({x}) / sqrt(count(*)), 0)', 't_stat')} FROM {source} WHERE {x} IS NOT NULL AND {where} GROUP BY {by}"


def _reports(sql: dict[str, str]) -> dict[str, str]:
    """SQL of the report queries; some read other queries' SQL."""
    cells = f"cells AS (SELECT interval, horizon, count(*) AS n, avg(signed_bps) AS mean, stddev_samp(signed_bps) / sqrt(count(*)) AS stderr, avg(signed_bps) / nullif(stddev_samp(signed_bps) / sqrt(count(*)), 0) AS t FROM ev WHERE signed_bps IS NOT NULL GROUP BY ALL)"
    judged = f"""WITH {EVENTS}, {cells},
tests AS (SELECT *, coalesce({t_p('t', 'n - 1')} < 0.05 / {TESTED_CELLS}, false) AS significant, coalesce(mean > {COSTS_BPS[0]}, false) AS above_cost, coalesce(mean - 2 * stderr > {COSTS_BPS[0]}, false) AS low_above_cost FROM cells),
judged AS (SELECT *, significant AND above_cost AND low_above_cost AS passes FROM tests)"""
    flags = ("significant", "above_cost", "low_above_cost", "passes")
    of_symbols = {x: f"mean_atr_{x}" for x in ("A", "N", "R")}
    squeezes = [x for x in GRID if x.family == "squeeze"]
    blue = {x.key: f"b{k}_" for k, x in enumerate(squeezes)}
    groups = ", ".join(f"count(signed_atr) FILTER (WHERE grp = '{g}') AS \"n_{g}\", {r6(f"avg(signed_atr) FILTER (WHERE grp = '{g}')", f'mean_{g}')}, {r6(f"stddev_samp(signed_atr) FILTER (WHERE grp = '{g}')", f'std_{g}')}" for g in ("S1", "S2", "S3"))
    definitions = {"any": "released OR became_blue", "gray": "released"}
    each = [f"{d} AS (SELECT interval, horizon, avg(signed_bps) AS mean, stddev_samp(signed_bps) AS std FROM (SELECT *, ret_bps * val_sign AS signed_bps FROM (SELECT interval, {SIGN} AS val_sign, {long()} FROM study WHERE {VALID} AND ({w}))) WHERE signed_bps IS NOT NULL GROUP BY ALL)" for d, w in (("any_", definitions["any"]), ("gray_", definitions["gray"]))]
    agree = " AND ".join(f"(a.{c} IS NOT DISTINCT FROM g.{c} OR coalesce(abs(a.{c} - g.{c}) <= 1e-12, false))" for c in ("mean", "std"))
    listed = "PARTITION BY passes_all ORDER BY score NULLS LAST, setting_key, interval"
    return {
        "causality_check": "SELECT '' AS builder, '' AS \"column\", CAST(0 AS BIGINT) AS changed WHERE false",
        "negative_controls": _controls(),
        **_bootstraps(),
        "p_values": f"WITH {EVENTS}, m AS ({summary('ev', 'interval, horizon', 'signed_bps')}), {cells} SELECT m.*, {r6(t_p('t', 'cells.n - 1'), 'p_value')} FROM m JOIN cells USING (interval, horizon)",
        "volatility_p_values": f"SELECT *, {r6(t_p('sqrt(statistic)', 'n_events + n_baseline - 2'), 'p_value')} FROM ({sql['volatility_expansion']})",
        "plateau_p_values": f"SELECT family, interval, n_settings, {r6('rho', 'spearman')}, {r6('t', 't_stat')}, {r6(t_p('t', 'n_settings - 2'), 'p_value')} FROM (SELECT *, rho * sqrt(n_settings - 2.0) / nullif(sqrt(1 - rho * rho), 0) AS t FROM ({sql['plateau'].replace(r6('corr(ra, rb)', 'spearman'), 'corr(ra, rb) AS rho')}))",
        "period_edges": f"WITH {EVENTS}, pe AS (SELECT *, {_edge_period('close_time')} AS period FROM ev) {summary('pe', 'period, horizon', 'signed_bps', 'period IS NOT NULL')}",
        "confirmation_table": _confirmation_table(),
        "overlapping_periods": f"WITH {EVENTS}, pd AS (SELECT DISTINCT year(l_shipdate) || '+2' AS period, make_date(year(l_shipdate), 1, 1) AS b, make_date(year(l_shipdate) + 2, 1, 1) AS e FROM lineitem WHERE l_shipdate IS NOT NULL), pe AS (SELECT ev.*, period FROM ev JOIN pd ON close_time >= b AND close_time < e) {summary('pe', 'period, horizon', 'signed_bps')}",
        "bar_ranks": f"WITH {BARS}, rk AS (SELECT symbol, interval, bar_index, rank() OVER (PARTITION BY symbol, interval ORDER BY close DESC) + (count(*) OVER (PARTITION BY symbol, interval, close) - 1) / 2.0 AS a, count(*) OVER (PARTITION BY symbol, interval) AS n FROM bars) SELECT {AT}, {r6('a', 'rank')}, {r6('a / n', 'percentile')} FROM rk",
        "passing_cells": f"{judged} SELECT interval, horizon, n, {r6('mean')}, {', '.join(flags)} FROM judged",
        "pass_counts": f"{judged} SELECT interval, count(*) AS cells, {', '.join(f'count(*) FILTER (WHERE {f}) AS n_{f}' for f in flags)}, bool_or(passes) AS any_passes, bool_and(passes) AS all_pass FROM judged GROUP BY 1",
        "definition_pivot": f"WITH {STUDY} SELECT symbol, count(*) FILTER (WHERE released OR became_blue) AS n_any, count(*) FILTER (WHERE released) AS n_gray, count(*) FILTER (WHERE became_blue) AS n_blue FROM study WHERE {VALID} GROUP BY 1",
        "symbol_pivot": f"WITH {EVENTS} SELECT symbol, {_wide('horizon', BY_HORIZON, 'signed_bps')} FROM ev GROUP BY 1",
        "grid_pivot": f"WITH RECURSIVE {CELLS}, {_grid_values()} SELECT g.setting_key, g.label, {_wide('c.horizon', BY_HORIZON, 'c.mean_atr', 'max')} FROM grid g LEFT JOIN cells c USING (setting_key) GROUP BY 1, 2",
        "grid_blue_bars": f"WITH {BARS}, {', '.join(squeeze(x.params['kc_mult'], x.params['bb_length'], x.params['kc_length'], pre=blue[x.key]) for x in squeezes)} {' UNION ALL '.join(f"SELECT '{x.label}' AS label, count(*) FILTER (WHERE no_sqz) AS blue_bars FROM {blue[x.key]}sq" for x in squeezes)}",
        "grid_symbol_means": f"WITH RECURSIVE {_cell_signals(GRID)} SELECT setting_key, horizon, {_wide('symbol', of_symbols, 'signed_atr')} FROM gs GROUP BY 1, 2",
        "result_identity": f"WITH {STUDY}, {', '.join(each)} SELECT count(*) AS cells, count(*) FILTER (WHERE a.interval IS NULL OR g.interval IS NULL) AS unmatched, coalesce(bool_and(a.interval IS NOT NULL AND g.interval IS NOT NULL AND {agree}), true) AS identical FROM any_ a FULL JOIN gray_ g USING (interval, horizon)",
        "selection_lists": f"SELECT setting_key, interval, score, score_percentile, neighbour_percentile, best_horizon, mean_atr, mean_bps, n_signals, passes_neighbour, passes_signs, passes_all, CASE WHEN passes_all THEN 'passed' ELSE 'dropped' END AS list, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER ({listed}) AS place FROM ({sql['grid_selection']})) WHERE place <= CASE WHEN passes_all THEN 20 ELSE 15 END",
        "three_way": f"""WITH RECURSIVE {LED},
w AS (SELECT leader, horizon, count(*) FILTER (WHERE grp = 'S1') AS na, count(*) FILTER (WHERE grp = 'S3') AS nb, avg(signed_atr) FILTER (WHERE grp = 'S1') AS ma, avg(signed_atr) FILTER (WHERE grp = 'S3') AS mb, var_samp(signed_atr) FILTER (WHERE grp = 'S1') / count(*) FILTER (WHERE grp = 'S1') AS sa, var_samp(signed_atr) FILTER (WHERE grp = 'S3') / count(*) FILTER (WHERE grp = 'S3') AS sb
  FROM sig WHERE prim AND grp IN ('S1', 'S3') AND signed_atr IS NOT NULL GROUP BY ALL),
x AS (SELECT leader, horizon, ma - mb AS difference, CASE WHEN na > 1 AND nb > 1 THEN (ma - mb) / nullif(sqrt(sa + sb), 0) END AS t, CASE WHEN na > 1 AND nb > 1 THEN (sa + sb) * (sa + sb) / nullif(sa * sa / (na - 1) + sb * sb / (nb - 1), 0) END AS v FROM w),
g AS (SELECT leader, horizon, {groups} FROM sig WHERE prim AND signed_atr IS NOT NULL GROUP BY ALL)
SELECT g.*, {r6('difference')}, {r6('t', 't_stat')}, {r6('v', 'dof')}, {r6(t_p('t', 'v'), 'p_value')} FROM g LEFT JOIN x USING (leader, horizon)""",
        "group_counts": f"WITH RECURSIVE {LED} SELECT leader, symbol, {', '.join(f"count(*) FILTER (WHERE grp = '{g}') AS n_{g}" for g in ('S1', 'S2', 'S3'))} FROM sig WHERE prim AND horizon = {HORIZONS[0]} GROUP BY ALL",
        "leader_symbols": f"WITH RECURSIVE {LED} SELECT leader, horizon, {_wide('symbol', of_symbols, 'signed_atr')} FROM sig WHERE prim GROUP BY ALL",
        "scrutiny": f"""WITH {EVENTS}, thin AS ({sql['non_overlap'].replace(many('signed_bps'), 'signed_bps')}),
part_s AS (SELECT *, {_edge_period('close_time')} AS period, ntile(2) OVER (PARTITION BY symbol, horizon ORDER BY bar_index) AS half FROM ev),
excl AS (SELECT DISTINCT symbol AS excluded FROM ev UNION ALL SELECT 'none'), left_ AS (SELECT * FROM ev JOIN excl ON ev.symbol <> excl.excluded)
{_moments('per_symbol', 'symbol', 'ev')} UNION ALL {_moments('leave_one_out', 'excluded', 'left_')} UNION ALL {_moments('halves', 'half', 'part_s')} UNION ALL {_moments('periods', 'period', 'part_s', 'period IS NOT NULL')} UNION ALL {_moments('horizons', "'all'", 'ev')} UNION ALL {_moments('thinned', "'all'", 'thin')}""",
    }


def oracle_sql() -> dict[str, str]:
    sql = {
        "bars_rows2": f"WITH {BARS} SELECT {AT}, {many('open', 'high', 'low', 'close', 'volume')}, close_time FROM bars",
        "bars_daily": f"WITH {DAILY} SELECT {AT}, open_time, close_time, {many('open', 'high', 'low', 'close', 'volume')}, count FROM daily",
        "bars_events_4h": f"WITH {EVENTS_4H} SELECT {AT}, open_time, close_time, {many('open', 'high', 'low', 'close', 'volume')}, count FROM four",
        "integrity_report": f"""WITH {DAILY},
g AS (SELECT symbol, interval, open_time, epoch(open_time) - lag(epoch(open_time)) OVER (PARTITION BY symbol ORDER BY open_time) AS gap FROM daily),
a AS (SELECT symbol, interval, count(*) AS n, count(DISTINCT open_time) AS actual, CAST((epoch(max(open_time)) + 86400 - epoch(min(open_time))) / 86400 AS BIGINT) AS expected, count(*) FILTER (WHERE gap <> 0 AND gap <> 86400) AS irregular FROM g GROUP BY ALL)
SELECT symbol, interval, expected AS expected_bars, actual AS actual_bars, n - actual AS duplicated_times, expected - actual AS missing_bars, irregular AS irregular_steps, expected = actual AS complete FROM a""",
        "missing_times": f"{MISSING} SELECT symbol, open_time FROM missing",
        "missing_pattern": f"""{MISSING},
k AS (SELECT 'time' AS kind, strftime(open_time, '%H:%M:%S') AS value FROM missing UNION ALL SELECT 'day', strftime(open_time, '%d') FROM missing),
c AS (SELECT kind, value, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS place, (SELECT count(*) FROM missing) AS total FROM c)
SELECT kind, value, n, CAST(place AS INTEGER) AS place, round(n / total, 6) AS share, n / total > 0.3 AND total >= 10 AS concentrated FROM p WHERE place <= 5""",
        "spacing_faults": f"""WITH {EVENTS_1H}, g AS (SELECT symbol, epoch(open_time) - lag(epoch(open_time)) OVER ({WIN}) AS gap FROM hourly)
SELECT symbol, count(*) FILTER (WHERE gap <> 3600) AS faults FROM g GROUP BY 1""",
        "true_range": f"{DEFAULT} SELECT {AT}, {many('true_range')} FROM sq",
        "bollinger": f"{DEFAULT} SELECT {AT}, {many('basis', 'dev', 'upper_bb', 'lower_bb')} FROM sq",
        "keltner": f"{DEFAULT} SELECT {AT}, {many('kc_ma', 'rangema', 'upper_kc', 'lower_kc', 'atr_norm')} FROM sq",
        "squeeze_states": f"WITH {BARS}, {squeeze(1.0)} SELECT {AT}, sqz_on, sqz_off, no_sqz FROM sq",
        "squeeze_run": f"WITH {BARS}, {squeeze(1.0)} SELECT {AT}, squeeze_run FROM sq",
        "color_state": f"{DEFAULT} SELECT {AT}, color_state, val_rising FROM sq",
        "linreg_momentum": f"{DEFAULT} SELECT {AT}, {many('val')} FROM sq",
        "val_norm": f"{DEFAULT} SELECT {AT}, {many('val_norm')} FROM sq",
        "state_structure": f"WITH {BARS}, {squeeze(1.0)} SELECT symbol, interval, {r6('max(abs(basis - kc_ma))', 'max_difference')}, count(*) FILTER (WHERE no_sqz) AS blue_bars, bool_and(sqz_on = coalesce(dev < rangema * 1.0, false)) AS equivalent FROM sq GROUP BY 1, 2",
        "ema": smooth(2 / 11, "ema"),
        "wilder": smooth(1 / 14, "wilder"),
        "wavetrend": f"WITH RECURSIVE {BARS}, {wt_lines(10, 21)} SELECT symbol, '2r' AS interval, bar_index, {many('hlc3', 'esa', 'd', 'ci', 'wt1', 'wt2')}, cross_up, cross_down, oversold_zone, overbought_zone FROM wt",
        "adx": f"WITH RECURSIVE {BARS}, {adx_lines(14)} SELECT symbol, '2r' AS interval, bar_index, {many('true_range', 'plus_dm', 'minus_dm', 'plus_di', 'minus_di', 'dx', 'adx')}, coalesce(adx > 20 AND before <= 20, false) AS cross_threshold, coalesce(adx > 25 AND before <= 25, false) AS cross_secondary, bullish FROM ax",
        "zero_divisions": f"WITH RECURSIVE {BARS}, {wt_lines(10, 21)} SELECT symbol, '2r' AS interval, count(*) FILTER (WHERE d = 0) AS zero_division_bars FROM wt GROUP BY 1",
        "forward_returns": f"WITH {BARS}, {targets('bars', 't', atr=False)} SELECT {AT}, {many(*(f'ret_{h}_bps' for h in HORIZONS))} FROM t",
        "release_events": f"WITH {EVENTS} SELECT symbol, bar_index, horizon, run_before, CAST(hour(close_time) AS INTEGER) AS utc_hour, {many('val', 'val_norm', 'val_sign')}, val_rising, {many('ret_bps', 'ret_atr')} FROM ev",
        "baseline_bars": f"WITH {STUDY}, {BASE} SELECT symbol, horizon, count(*) AS bars, count(ret_bps) AS n, {r6('avg(ret_bps)', 'mean_bps')}, {r6('avg(ret_atr)', 'mean_atr')} FROM base GROUP BY 1, 2",
        "bar_move": f"WITH {BARS}, m AS (SELECT symbol, interval, abs(close / lag(close) OVER ({WIN}) - 1) * 10000 AS move FROM bars) SELECT symbol, interval, {r6('median(move)', 'bar_move_bps')} FROM m GROUP BY 1, 2",
        "release_definitions": f"WITH {STUDY} SELECT symbol, count(*) FILTER (WHERE released) AS gray, count(*) FILTER (WHERE became_blue) AS blue, count(*) FILTER (WHERE released OR became_blue) AS \"any\", count(*) AS bars FROM study WHERE {VALID} GROUP BY 1",
        "event_totals": f"""WITH {STUDY},
m AS (SELECT symbol, interval, median(move) AS move FROM (SELECT symbol, interval, abs(close / lag(close) OVER ({WIN}) - 1) * 10000 AS move FROM bars) GROUP BY 1, 2),
c AS (SELECT symbol, interval, count(*) FILTER (WHERE released AND {VALID}) AS n_events, count(*) FILTER (WHERE {VALID}) AS n_bars FROM study GROUP BY 1, 2)
SELECT symbol, interval, n_events, n_bars, {r6('move', 'bar_move_bps')}, {', '.join(r6(f'move / {c}', f"move_over_{str(c).replace('.', '_')}") for c in COSTS_BPS)} FROM c JOIN m USING (symbol, interval)""",
        "direction_summary": f"WITH {EVENTS} {summary('ev', 'interval, horizon', 'signed_bps')}",
        "direction_accel": f"WITH {EVENTS} {summary('ev', 'interval, horizon', 'signed_bps', '(val > 0 AND val_rising) OR (val <= 0 AND NOT val_rising)')}",
        "per_symbol": f"WITH {EVENTS} {summary('ev', 'symbol, horizon', 'signed_bps')}",
        "leave_one_out": f"WITH {EVENTS}, excl AS (SELECT DISTINCT symbol AS excluded FROM ev UNION ALL SELECT 'none'), j AS (SELECT * FROM ev JOIN excl ON ev.symbol <> excl.excluded) {summary('j', 'excluded, horizon', 'signed_bps')}",
        "period_split": f"WITH {EVENTS}, {_period('ev', 'pe')} {summary('pe', 'period, horizon', 'signed_bps')}",
        "baseline_direction": f"WITH {STUDY}, {BASE} {summary('base', 'interval, horizon', 'signed_bps')}",
        "run_buckets": f"WITH {EVENTS}, m AS (SELECT unnest([{', '.join(map(str, RUN_BUCKETS))}]) AS min_run) SELECT min_run, horizon, count(*) AS n, {r6('avg(ret_bps)', 'mean_raw')}, {r6('avg(signed_bps)', 'mean_signed')}, {r6('avg(signed_bps) / nullif(stddev_samp(signed_bps) / sqrt(count(*)), 0)', 't_stat')} FROM ev JOIN m ON run_before >= min_run WHERE signed_bps IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
        "hour_of_day": f"WITH {EVENTS_4H}, {targets('four', 't', (6,), False)} SELECT CAST(hour(close_time) AS INTEGER) AS utc_hour, count(*) AS size, {r6('avg(ret_6_bps)', 'mean_bps')}, {r6('median(abs(ret_6_bps))', 'median_abs_bps')}, {r6('count(*) / (SELECT count(*) FROM t)', 'share')}, {r6('count(*) / (SELECT count(*) FROM t) * 24', 'vs_uniform')} FROM t GROUP BY 1",
        "volatility_expansion": f"""WITH {EVENTS}, {BASE},
u AS (SELECT horizon, ret_bps AS x, true AS e FROM ev WHERE ret_bps IS NOT NULL UNION ALL SELECT horizon, ret_bps, false FROM base WHERE ret_bps IS NOT NULL),
m AS (SELECT horizon, e, median(x) AS m, stddev_samp(x) AS s, median(abs(x)) AS a FROM u GROUP BY ALL),
z AS (SELECT u.horizon, u.e, abs(u.x - m.m) AS z FROM u JOIN m USING (horizon, e)),
p AS (SELECT z.horizon, z.e, count(*) AS n, avg(z) AS zm, var_pop(z) AS v, any_value(m.s) AS s, any_value(m.a) AS a FROM z JOIN m USING (horizon, e) GROUP BY ALL),
w AS (SELECT t.horizon, t.n AS n1, f.n AS n0, t.zm AS m1, f.zm AS m0, t.v AS v1, f.v AS v0, t.s / f.s AS sr, t.a / f.a AS ar, (t.n * t.zm + f.n * f.zm) / (t.n + f.n) AS g FROM p t JOIN p f ON t.horizon = f.horizon AND t.e AND NOT f.e)
SELECT horizon, n1 AS n_events, n0 AS n_baseline, {r6('(n1 + n0 - 2) * (n1 * (m1 - g) * (m1 - g) + n0 * (m0 - g) * (m0 - g)) / (n1 * v1 + n0 * v0)', 'statistic')}, {r6('sr', 'std_ratio')}, {r6('ar', 'median_abs_ratio')} FROM w""",
        "leader_signals": f"WITH RECURSIVE {LED} SELECT leader, symbol, bar_index, horizon, {many('direction')}, sec AS secondary, sqz_on, recent_release_3, recent_release_6, recent_release_12, grp AS \"group\", {many('signed_bps', 'signed_atr')} FROM sig WHERE prim",
        "leader_secondary": f"WITH RECURSIVE {LED} SELECT leader, symbol, horizon, count(signed_atr) AS n, {r6('avg(signed_atr)', 'mean_atr')} FROM sig WHERE sec GROUP BY ALL",
        "leader_summary": f"""WITH RECURSIVE {LED},
lead_s AS ({summary('sig', 'leader, horizon', 'signed_atr', 'prim')}),
lead_a AS (SELECT leader, horizon, coalesce(count(DISTINCT sign(m)) = 1, false) AS signs_agree FROM (SELECT leader, horizon, symbol, avg(signed_atr) AS m FROM sig WHERE prim AND signed_atr IS NOT NULL GROUP BY ALL) GROUP BY ALL),
lead_b AS (SELECT leader, horizon, {r6('avg(signed_bps)', 'mean_bps')} FROM sig WHERE prim AND signed_atr IS NOT NULL GROUP BY ALL)
SELECT * FROM lead_s JOIN lead_a USING (leader, horizon) JOIN lead_b USING (leader, horizon)""",
        "leader_groups": f"WITH RECURSIVE {LED}, gg AS (SELECT *, grp AS \"group\" FROM sig WHERE prim) {summary('gg', 'leader, \"group\", horizon', 'signed_atr')}",
        "group_difference": f"""WITH RECURSIVE {LED},
g AS (SELECT leader, horizon, count(*) FILTER (WHERE grp = 'S1') AS na, count(*) FILTER (WHERE grp = 'S3') AS nb, avg(signed_atr) FILTER (WHERE grp = 'S1') AS ma, avg(signed_atr) FILTER (WHERE grp = 'S3') AS mb, var_samp(signed_atr) FILTER (WHERE grp = 'S1') / count(*) FILTER (WHERE grp = 'S1') AS sa, var_samp(signed_atr) FILTER (WHERE grp = 'S3') / count(*) FILTER (WHERE grp = 'S3') AS sb
  FROM sig WHERE prim AND grp IN ('S1', 'S3') AND signed_atr IS NOT NULL GROUP BY ALL)
SELECT leader, horizon, na AS n_a, nb AS n_b, {r6('ma', 'mean_a')}, {r6('mb', 'mean_b')}, {r6('ma - mb', 'difference')}, {r6('CASE WHEN na > 1 AND nb > 1 THEN (ma - mb) / nullif(sqrt(sa + sb), 0) END', 't_stat')}, {r6('CASE WHEN na > 1 AND nb > 1 THEN (sa + sb) * (sa + sb) / nullif(sa * sa / (na - 1) + sb * sb / (nb - 1), 0) END', 'dof')} FROM g""",
        "non_overlap": f"""WITH RECURSIVE {EVENTS},
e AS MATERIALIZED (SELECT symbol, horizon, bar_index, signed_bps, row_number() OVER (PARTITION BY symbol, horizon ORDER BY bar_index) AS k FROM ev WHERE ret_bps IS NOT NULL),
kept AS (SELECT symbol, horizon, k, bar_index, true AS keep, bar_index AS last FROM e WHERE k = 1
  UNION ALL SELECT e.symbol, e.horizon, e.k, e.bar_index, e.bar_index >= r.last + e.horizon + 1, CASE WHEN e.bar_index >= r.last + e.horizon + 1 THEN e.bar_index ELSE r.last END FROM kept r JOIN e ON e.symbol = r.symbol AND e.horizon = r.horizon AND e.k = r.k + 1)
SELECT symbol, horizon, bar_index, {many('signed_bps')} FROM kept JOIN e USING (symbol, horizon, k, bar_index) WHERE keep""",
        "grid_settings": f"WITH {_grid_values()} SELECT family, label, setting_key, array_to_string(axis, ',') AS axis_index FROM grid",
        "grid_neighbours": f"WITH {NEAR} SELECT * FROM near",
        "grid_cells": f"WITH RECURSIVE {CELLS} SELECT setting_key, family, interval, horizon, CAST(n_signals AS BIGINT) AS n_signals, {many('mean_atr', 'mean_bps', 'win_rate')}, signs_agree FROM cells",
        "grid_scores": f"WITH RECURSIVE {RANKED} SELECT setting_key, family, interval, {many('score', 'score_percentile')} FROM scores",
        "grid_selection": f"""WITH RECURSIVE {MEDIANS},
best AS (SELECT setting_key, interval, arg_min({{'h': horizon, 'a': mean_atr, 'b': mean_bps, 'n': n_signals, 's': signs_agree}}, {{'r': rank_in_cell, 'h': horizon}}) AS b FROM ranked WHERE rank_in_cell IS NOT NULL GROUP BY 1, 2),
j AS (SELECT s.*, n_neighbours, neighbour_median_score, b.h AS best_horizon, b.a AS mean_atr, b.b AS mean_bps, CAST(b.n AS BIGINT) AS n_signals, b.s AS signs_agree FROM scores s LEFT JOIN medians m USING (setting_key, interval) JOIN best USING (setting_key, interval)),
q AS (SELECT *, CASE WHEN neighbour_median_score IS NOT NULL THEN (rank() OVER (PARTITION BY interval ORDER BY neighbour_median_score NULLS LAST) + (count(*) OVER (PARTITION BY interval, neighbour_median_score) - 1) / 2.0::DOUBLE) / count(neighbour_median_score) OVER (PARTITION BY interval) END AS neighbour_percentile FROM j)
SELECT setting_key, interval, family, {many('score', 'score_percentile')}, n_neighbours, {many('neighbour_median_score')}, best_horizon, {many('mean_atr', 'mean_bps')}, n_signals, signs_agree, {many('neighbour_percentile')}, coalesce(neighbour_percentile <= 0.3, false) AS passes_neighbour, signs_agree AS passes_signs, coalesce(neighbour_percentile <= 0.3, false) AND signs_agree AS passes_all FROM q""",
        "plateau": f"""WITH RECURSIVE {MEDIANS},
rk AS (SELECT family, interval, rank() OVER (PARTITION BY family, interval ORDER BY score) + (count(*) OVER (PARTITION BY family, interval, score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY family, interval ORDER BY neighbour_median_score) + (count(*) OVER (PARTITION BY family, interval, neighbour_median_score) - 1) / 2.0::DOUBLE AS rb FROM scores JOIN medians USING (setting_key, interval))
SELECT family, interval, count(*) AS n_settings, {r6('corr(ra, rb)', 'spearman')} FROM rk GROUP BY 1, 2""",
        "part_b": f"""WITH RECURSIVE {PART_B}, {_confirmation('period < 2', 'pa')}, {_confirmation('period >= 2', 'pb')}
SELECT b.setting_key, b.interval, b.horizon, b.n, {r6('b.mean_atr', 'mean_atr')}, {r6('b.mean_bps', 'mean_bps')}, {r6('b.t_stat', 't_stat')}, {r6('b.win_rate', 'win_rate')}, g.signs_agree, {r6('b.mean_atr / nullif(a.mean_atr, 0)', 'retention')}, {r6('a.mean_atr', 'mean_a')}
FROM pb b JOIN pb_a g USING (setting_key, interval, horizon) LEFT JOIN pa a USING (setting_key, interval, horizon)""",
        "quarterly_stability": f"""WITH RECURSIVE {PART_B},
qt AS (SELECT setting_key, interval, horizon, year(close_time) || 'Q' || quarter(close_time) AS quarter, count(*) AS n, sum(signed_bps) AS total, avg(signed_bps) AS mean FROM pg WHERE signed_bps IS NOT NULL GROUP BY ALL),
qb AS (SELECT *, row_number() OVER (PARTITION BY setting_key, interval, horizon ORDER BY mean DESC, quarter) = 1 AS best FROM qt)
SELECT setting_key, interval, horizon, count(*) AS quarters, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE mean > 0) AS positive_quarters, count(*) FILTER (WHERE mean > 0.85) AS above_cost_quarters, max(quarter) FILTER (WHERE best) AS best_quarter, {r6('sum(total) / sum(n)', 'mean_bps')}, {r6('sum(total) FILTER (WHERE NOT best) / nullif(sum(n) FILTER (WHERE NOT best), 0)', 'mean_without_best')} FROM qb GROUP BY 1, 2, 3""",
        "cost_matrix": f"""WITH {EVENTS}, c AS (SELECT interval, horizon, avg(signed_bps) - 2 * (stddev_samp(signed_bps) / sqrt(count(*))) AS low FROM ev WHERE signed_bps IS NOT NULL GROUP BY 1, 2)
SELECT interval, horizon, {many('low')}, {', '.join(f"coalesce(low > {c}, false) AS above_{str(c).replace('.', '_')}" for c in COSTS_BPS)} FROM c""",
    }
    return {**sql, **_reports(sql)}
