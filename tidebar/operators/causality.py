"""Causality by truncation: a feature at t must not change when later bars are cut away.

All truncations of a builder are one job: each cut's bars are a series of their
own. A builder may declare its reach, the bars before a bar that its features
there depend on; then a cut repeats only the bars that the COMPARED ones before
it reach back to, found by a join of ranges over blocks of bars, and not all of
the series up to the cut. A reach may differ from bar to bar, as a run's length
does. Builders of a bar and of totals of its series declare those: a cut's are
merged from those of blocks of bars, so that no prefix is repeated. Others run
on whole prefixes, of which there are 168 a series at most.

Results are compared by a full outer join on (series, bar): a row that only one
side has, or has more often, differs as a changed value does. Compared are the
COMPARED bars before each cut: what looks ahead from there, however far within the
series, shows at that cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions import series as s
from tidebar.functions.shared import kept

FeatureBuilder = Callable[[DataFrame], DataFrame]
RUN, SCATTERED, TOLERANCE = 64, 40, 1e-9
#: Bars before a cut that are compared, and bars of a block that ranges are joined by.
COMPARED, BLOCK = 64, 1024

#: What stands for a column where the builder's rows themselves differ.
ROWS = "(rows)"


class LookAheadError(AssertionError):
    """Features change when later bars are cut away."""


def reaching(reach: int | Callable[[], Column]) -> Callable[[FeatureBuilder], FeatureBuilder]:
    """Declares a builder's reach: a number of bars, or a column of its result that has the number for each bar."""

    def declared(builder: FeatureBuilder) -> FeatureBuilder:
        builder.reach = reach
        return builder

    return declared


def lined(kernel: Callable, columns: dict[str, str], lookback: int, runs: dict[str, str] | None = None) -> Callable[[FeatureBuilder], FeatureBuilder]:
    """Declares what a builder gives series.recursive by default, so that several share one pass over the bars (see together)."""

    def declared(builder: FeatureBuilder) -> FeatureBuilder:
        builder.lines = (kernel, columns, lookback, runs or {})
        return builder

    return declared


#: How totals of parts of a series make those of the whole.
MERGED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def totalling(**totals: tuple[str, Callable[[], Column]]) -> Callable[[FeatureBuilder], FeatureBuilder]:
    """Declares that a builder's features at a bar depend on the bar and on totals of its series alone: each a name, its aggregate (of MERGED) and of what. The builder gets bars that carry them."""

    def declared(features: FeatureBuilder) -> FeatureBuilder:
        def build(bars: DataFrame) -> DataFrame:
            return features(bars.join(_totals(bars, s.keys(bars), totals), s.keys(bars))).drop(*totals)

        build.totals, build.features = totals, features
        return build

    return declared


def _totals(bars: DataFrame, by: list[str], totals: dict) -> DataFrame:
    return bars.groupBy(*by).agg(*[getattr(F, how)(of()).alias(name) for name, (how, of) in totals.items()])


def _totals_before(bars: DataFrame, cuts: DataFrame, totals: dict) -> DataFrame:
    """symbol, interval, cut and the totals of the bars before it: those of whole blocks, summed along the series, and of the bars of the cut's own block."""
    series = list(s.SERIES)
    merge = lambda name: MERGED[totals[name][0]](name)
    blocks = _totals(bars.withColumn("_block", F.expr(f"{s.ORDER} div {BLOCK}")), [*series, "_block"], totals)
    # cuts stand among the blocks, each ahead of the one it is in
    marks = cuts.withColumn("_block", F.expr(f"cut div {BLOCK}").cast("long"))
    before = Window.partitionBy(*series).orderBy("_block", F.col("cut").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = marks.unionByName(blocks, allowMissingColumns=True)
    whole = along.select(*series, "cut", *[merge(name).over(before).alias(name) for name in totals]).where("cut is not null")
    own = cuts.select(*series, "cut", F.expr(f"cast(cut div {BLOCK} * {BLOCK} as long)").alias("begin"), F.col("cut").cast("long").alias("end"))
    rest = _totals(_within(bars, own), [*series, "cut"], totals)
    return whole.unionByName(rest).groupBy(*series, "cut").agg(*[merge(name).alias(name) for name in totals])


def chunked(back: int, ahead: int) -> Callable[[FeatureBuilder], FeatureBuilder]:
    """Declares that a builder's windows reach so many bars; it gets bars in chunks that carry them, so that no task holds a series."""

    def declared(builder: FeatureBuilder) -> FeatureBuilder:
        def build(bars: DataFrame) -> DataFrame:
            if "chunk" in bars.columns:
                return builder(bars)
            return s.gathered(builder(s.spread(bars, back, ahead, s.CHUNK_BARS)))

        build.spread = (back, ahead)
        return build

    return declared


def cut_positions(bars: int, warmup: int = 0) -> list[int]:
    """A run of cuts at the end, one in the middle, and scattered ones."""
    first, end = max(warmup + 5, 10), bars - 1
    if end <= first:
        raise ValueError("too few bars to cut")
    middle = (first + end) // 2
    spots = [first + (end - 1 - first) * k // (SCATTERED - 1) for k in range(SCATTERED)]
    return sorted({*range(max(first, end - RUN), end), *range(middle, min(middle + RUN, end)), *spots})


def series_cuts(bars: DataFrame, warmup: int = 0) -> DataFrame:
    """symbol, interval, cuts: cut_positions of each series' own length; a series of too few bars has none."""
    first = max(warmup + 5, 10)
    ends = bars.groupBy(*s.SERIES).agg((F.max(s.ORDER).cast("int")).alias("end")).where(F.col("end") > first)
    cuts = F.expr(
        f"""array_sort(array_distinct(concat(
              sequence(greatest({first}, end - {RUN}), end - 1),
              sequence(({first} + end) div 2, least(({first} + end) div 2 + {RUN}, end) - 1),
              transform(sequence(0, {SCATTERED - 1}), k -> {first} + (end - 1L - {first}) * k div {SCATTERED - 1}))))"""
    )
    return ends.select(*s.SERIES, cuts.cast("array<int>").alias("cuts"))


def _within(rows: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows repeated for each range (series, cut, begin, end) that holds their bar: a join on blocks of bars."""
    series = list(s.SERIES)
    blocks = F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))
    spans = ranges.where(F.col("end") > F.col("begin")).withColumn("_block", F.explode(blocks))
    met = rows.withColumn("_block", F.expr(f"{s.ORDER} div {block}")).join(spans, [*series, "_block"])
    return met.where((F.col(s.ORDER) >= F.col("begin")) & (F.col(s.ORDER) < F.col("end"))).drop("_block", "begin", "end")


def _anchored(cuts: DataFrame, near: DataFrame, reach: int | Callable[[], Column] | None) -> DataFrame:
    """The range of bars of each cut that the compared ones reach back to. near: those, with features and their cut."""
    series = list(s.SERIES)
    if reach is None or isinstance(reach, int):
        begin = F.lit(0) if reach is None else F.greatest(F.lit(0), F.col("cut") - COMPARED - reach)
        return cuts.withColumns({"begin": begin.cast("long"), "end": F.col("cut").cast("long")})
    least = near.groupBy(*series, "cut").agg(F.min(F.coalesce(F.col(s.ORDER) - reach(), F.lit(0))).alias("_least"))
    begin = F.greatest(F.lit(0), F.coalesce("_least", F.lit(0)))
    return cuts.join(least, [*series, "cut"], "left").select(*series, "cut", begin.cast("long").alias("begin"), F.col("cut").cast("long").alias("end"))


def _compared(cuts: DataFrame) -> DataFrame:
    return cuts.withColumns({"begin": F.greatest(F.lit(0), F.col("cut") - COMPARED).cast("long"), "end": F.col("cut").cast("long")})


def _marked(bars: DataFrame, cuts: DataFrame) -> DataFrame:
    """bars with wanted: whether a cut compares them."""
    ranges = _compared(cuts).where(F.col("end") > F.col("begin"))
    at = ranges.select(*s.SERIES, F.explode(F.sequence("begin", F.col("end") - 1)).alias(s.ORDER)).distinct()
    at = kept(at.withColumn("_met", F.lit(True)), "wanted")
    return bars.join(at, [*s.SERIES, s.ORDER], "left").withColumn("wanted", F.col("_met").isNotNull()).drop("_met")


def differences(builder: FeatureBuilder, bars: DataFrame, cuts: list[int] | DataFrame) -> DataFrame:
    """symbol, cut, column, changed, first_index: features that a cut changes, ROWS where rows do. cuts: of all series, or series_cuts."""
    series = list(s.SERIES)
    keys = [*series, "cut", s.ORDER]
    if not isinstance(cuts, DataFrame):
        cuts = bars.select(*series).distinct().withColumn("cuts", F.array(*[F.lit(c) for c in sorted(cuts)]))
    # written, as are the bars compared: what Spark knows to be small is broadcast, and the bars stay where they are
    cuts = kept(cuts.select(*series, F.explode("cuts").alias("cut")), "cuts")
    sparing = hasattr(builder, "sparing")
    if totals := getattr(builder, "totals", None):
        rows = kept(_within(bars, _compared(cuts), COMPARED), "compared")
        near = builder.features(rows.join(_totals(bars, series, totals), series)).drop(*totals)
        truncated = builder.features(rows.join(_totals_before(bars, cuts, totals), [*series, "cut"])).drop(*totals)
    else:
        whole = builder(_marked(bars, cuts)).drop("wanted") if sparing else builder(bars)
        near = kept(_within(whole, _compared(cuts), COMPARED), "compared")
        rows = _within(bars, kept(_anchored(cuts, near, getattr(builder, "reach", None)), "ranges"))
        truncated = builder(rows.withColumn("wanted", F.col(s.ORDER) >= F.col("cut") - COMPARED)).drop("wanted") if sparing else builder(rows)
    made = [c for c in near.columns if c not in (*bars.columns, "cut")]
    kinds = dict(near.dtypes)
    values = F.struct(*[F.col(c) for c in made], F.lit(0).alias("_"))  # one row a key; repeated ones differ by their number
    side = lambda rows, x: rows.groupBy(*keys).agg(F.count("*").alias(f"{x}_rows"), F.max(values).alias(x))
    a = side(near, "a")
    b = side(truncated.where(F.col(s.ORDER) >= F.col("cut") - COMPARED), "b")
    both = a.join(b, keys, "full_outer")
    each = [F.when(~F.col("a_rows").eqNullSafe(F.col("b_rows")), F.lit(ROWS))]
    for c in made:
        x, y = F.col("a")[c], F.col("b")[c]
        same = x.eqNullSafe(y)
        if kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= TOLERANCE + TOLERANCE * F.abs(y), F.lit(False))
        each.append(F.when(F.col("a_rows").isNotNull() & F.col("b_rows").isNotNull() & ~same, F.lit(c)))
    rows = both.select("symbol", "cut", s.ORDER, F.explode(F.array_compact(F.array(*each))).alias("column"))
    return rows.groupBy("symbol", "cut", "column").agg(F.count("*").alias("changed"), F.min(s.ORDER).alias("first_index"))


def together(builders: dict[str, FeatureBuilder]) -> list[FeatureBuilder]:
    """Builders that add columns to bars, as one of those with declared lines, which computes all bars in one pass and sends the compared ones on, one of those with a declared reach, one of those of totals and one of the others; a column is named builder/column, and names has each one's builders."""

    def fused(some: dict[str, FeatureBuilder]) -> FeatureBuilder:
        parts = {f"{name}/": f.lines for name, f in some.items()}
        columns = {p + c: t for p, (_, made, _, _) in parts.items() for c, t in made.items()}
        runs = {p + flag: p + out for p, (*_, of) in parts.items() for flag, out in of.items()}
        kernel = lambda b: {p + c: v for p, (k, *_) in parts.items() for c, v in k(b).items()}
        reaches = {f"{name}/": f.reach for name, f in some.items()}

        def build(bars: DataFrame) -> DataFrame:
            return s.recursive(bars, kernel, columns, max(x[2] for x in parts.values()), runs=runs)

        build.sparing = True
        return reaching(lambda: F.greatest(F.lit(0), *[F.lit(r) if isinstance(r, int) else r(p) for p, r in reaches.items()]))(build)

    def chained(some: dict[str, FeatureBuilder]) -> FeatureBuilder:
        def build(bars: DataFrame) -> DataFrame:
            out = bars
            for name, f in some.items():
                made = f(out)
                out = made.withColumnsRenamed({c: f"{name}/{c}" for c in made.columns if c not in out.columns})
            return out

        return build

    def joined(some: dict[str, FeatureBuilder]) -> FeatureBuilder:
        build = chained(some)
        if all(hasattr(f, "spread") for f in some.values()):
            build = chunked(*(max(f.spread[k] for f in some.values()) for k in (0, 1)))(build)
        reaches = [getattr(f, "reach", None) for f in some.values()]
        return reaching(max(reaches))(build) if all(isinstance(r, int) for r in reaches) else build

    def summed(some: dict[str, FeatureBuilder]) -> FeatureBuilder:
        return totalling(**{name: x for f in some.values() for name, x in f.totals.items()})(chained({n: f.features for n, f in some.items()}))

    lines = {n: f for n, f in builders.items() if hasattr(f, "lines")}
    near = {n: f for n, f in builders.items() if n not in lines and isinstance(getattr(f, "reach", None), int)}
    total = {n: f for n, f in builders.items() if hasattr(f, "totals")}
    rest = {n: f for n, f in builders.items() if n not in lines and n not in near and n not in total}
    out = []
    for make, some in ((fused, lines), (joined, near), (summed, total), (joined, rest)):
        if some:
            out.append(make(some))
            out[-1].names = list(some)
    return out


def assert_no_look_ahead(builder: FeatureBuilder, bars: DataFrame, warmup: int = 0) -> None:
    n = bars.groupBy("symbol").count().agg(F.min("count")).first()[0]
    bad = differences(builder, bars, cut_positions(n, warmup)).orderBy("cut", "column").limit(5).collect()
    if bad:
        raise LookAheadError("; ".join(f"{r['column']} changes at {r['changed']} bars from {r['first_index']} on when cut at {r['cut']}" for r in bad))


def _whole(df: DataFrame) -> Window:
    return Window.partitionBy(*s.keys(df))


def _onwards(df: DataFrame, within: Callable[[Window], Column], later: Column, carried: Callable[[Window], Column]) -> tuple[DataFrame, Column, Column]:
    """df with _carry, and two columns: a value of the chunk's bars from the present one on, and that of the chunks after it, one row a chunk. Frames go back in the reversed order: one that ends at the last row is computed anew for each row."""
    series = [c for c in s.keys(df) if c != "chunk"]
    after = Window.partitionBy(*series).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.where("own").groupBy(*series, "chunk").agg(later.alias("_later"))
    carry = chunks.select(*series, "chunk", carried(after).alias("_carry"))
    onwards = Window.partitionBy(*series, "chunk").orderBy(F.desc(s.ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_within", within(onwards)).join(carry, [*series, "chunk"])
    return df, F.col("_within"), F.col("_carry")


@totalling(_n=("count", lambda: F.col("close")), _sum=("sum", lambda: F.col("close")), _squares=("sum", lambda: F.col("close") * F.col("close")))
def _standardised(df: DataFrame) -> DataFrame:
    mean = F.col("_sum") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_squares") - F.col("_sum") * mean, F.lit(0.0)) / F.nullif(F.col("_n") - 1, F.lit(0)))
    return df.withColumn("bad", F.try_divide(F.col("close") - mean, spread))


@reaching(0)
@chunked(0, 0)
def _back_filled(df: DataFrame) -> DataFrame:
    holed = F.when(F.col("bar_index") % 50 != 0, F.col("close"))
    df, within, later = _onwards(df, lambda w: F.last(holed, ignorenulls=True).over(w), F.min_by(holed, F.when(holed.isNotNull(), F.col("bar_index"))), lambda w: F.last("_later", ignorenulls=True).over(w))
    return df.withColumn("bad", F.coalesce(within, later)).drop("_within", "_carry")


@reaching(0)
@chunked(0, 1)
def _next_close(df: DataFrame) -> DataFrame:
    return df.withColumn("bad", F.lead("close", 1).over(s.over(df)))


@reaching(20)
@chunked(10, 10)
def _centred(df: DataFrame) -> DataFrame:
    w = s.over(df).rowsBetween(-10, 10)
    return df.withColumn("bad", F.when(F.count("close").over(w) == 21, F.avg("close").over(w)))


@totalling(_least=("min", lambda: F.col("close")), _most=("max", lambda: F.col("close")))
def _scaled(df: DataFrame) -> DataFrame:
    return df.withColumn("bad", F.try_divide(F.col("close") - F.col("_least"), F.col("_most") - F.col("_least")))


@reaching(0)
@chunked(0, 0)
def _future_peak(df: DataFrame) -> DataFrame:
    df, within, later = _onwards(df, lambda w: F.max("close").over(w), F.max("close"), lambda w: F.max("_later").over(w))
    return df.withColumn("bad", F.greatest(within, later)).drop("_within", "_carry")


#: builders that look ahead on purpose: the checker must catch each
NEGATIVE_CONTROLS: dict[str, FeatureBuilder] = {
    "standardised": _standardised,
    "back_filled": _back_filled,
    "next_close": _next_close,
    "centred": _centred,
    "scaled": _scaled,
    "future_peak": _future_peak,
}


def verify_checker(bars: DataFrame) -> None:
    for name, builder in NEGATIVE_CONTROLS.items():
        try:
            assert_no_look_ahead(builder, bars)
        except LookAheadError:
            continue
        raise AssertionError(f"the checker doesn't catch {name}")
