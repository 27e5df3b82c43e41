r"""Quality rules with thresholds learnt per language and source.

Native: DataFrame functions only. Each measure of a document is a whole number;
its sketch is a histogram of bins by language and source: numbers up to
2^DIGITS have bins of their own, larger ones share a bin with those of the same
first DIGITS binary digits. Such sketches merge by adding counts, have at most
SKETCH_BINS bins whatever the rows, and don't depend on the order of rows. A
quantile has its exact rank, and is its bin's least number: too low by less
than one part in 2^(DIGITS - 1). A group of few documents takes the sketch
merged over its language, or else over all. A document is rejected by the base
rules or where a measure lies beyond its group's fence: the median plus SPREAD
times the way from the median to the 0.9 quantile, that way counted as LEAST
at least. Measures that may be too low as well have a fence on either side.

Defined cases: null and empty texts have no words and fail the base rules; null
languages and sources form groups of their own; repeated rows are judged alike;
an empty table gives an empty result; a group whose documents all fail the base
rules has no documents to judge. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.common import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fewest documents of a (language, source) or language that fences are taken from.
MIN_GROUP = 100
SPREAD = 6
#: Binary digits of a value that its bin keeps; bins that values of 63 digits can have.
DIGITS = 9
SKETCH_BINS = (1 << DIGITS) + (63 - DIGITS) * (1 << (DIGITS - 1))
#: Groups whose fences are broadcast; more of them are joined with salted keys instead.
BROADCAST_GROUPS = 50_000
SALTS = 16


@dataclass(frozen=True)
class Measure:
    name: str
    sql: str  # a whole number from the counts of a document that passed the base rules
    least: int  # least way from the median to the upper quantile
    both_sides: bool = False


MEASURES = (
    Measure("symbols", "1000 * n_symbols div n_words", 10),
    Measure("word_length", "100 * word_chars div n_words", 40, both_sides=True),
    Measure("dup_lines", "1000 * n_dup_lines div n_words", 10),
    Measure("repeats", "1000 * n_repeat_words div n_words", 30),
)

_SPACES = " \t\n\x0b\x0c\r"


def counts(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts.

    Repeats: each 3-word window is a hash with its position; sorted, equal
    hashes are neighbours, and the words of neighbours are compared.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(_SPACES))
    base = docs.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+")).alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("lines"),
    )
    base = base.select(
        *keep,
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
    )
    base = base.select(
        *base.columns,
        F.expr(
            """sort_array(if(n_words < 3, cast(array() as array<struct<h: bigint, i: int>>), transform(sequence(0, cast(n_words as int) - 3),
               i -> named_struct('h', xxhash64(words[i], words[i + 1], words[i + 2]), 'i', i))))"""
        ).alias("windows"),
    )
    same = "x.h = windows[{k}].h and words[x.i] = words[windows[{k}].i] and words[x.i + 1] = words[windows[{k}].i + 1] and words[x.i + 2] = words[windows[{k}].i + 2]"
    places = F.expr(
        f"""sort_array(transform(filter(windows, (x, i) ->
             (i > 0 and {same.format(k="i - 1")}) or (i < n_words - 3 and {same.format(k="i + 1")})),
           x -> x.i))"""
    )
    base = base.select(*[c for c in base.columns if c not in ("windows", "words")], places.alias("places"))
    covered = F.expr("if(size(places) = 0, 0L, 3L + aggregate(if(size(places) < 2, array(), sequence(0, size(places) - 2)), 0L, (n, i) -> n + least(3, places[i + 1] - places[i])))")
    return base.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def _group(name: str) -> Column:
    """A null is a group of its own, apart from every text."""
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(name)))


def _measured(counted: DataFrame) -> DataFrame:
    passed = ~base_failed()
    values = [F.when(passed, F.expr(m.sql)).cast("long").alias(m.name) for m in MEASURES]
    return counted.select("*", _group("lang").alias("g_lang"), _group("source").alias("g_source"), base_failed().alias("base_failed"), *values)


def _bin(value: str) -> str:
    """SQL: the least number of a value's bin."""
    rest = f"greatest(0, length(bin({value})) - {DIGITS})"
    return f"shiftleft(shiftright({value}, {rest}), {rest})"


def sketches(measured: DataFrame) -> DataFrame:
    """g_lang, g_source, measure, value (a bin), n of the documents that pass the base rules."""
    tall = measured.where("not base_failed").select("g_lang", "g_source", F.expr(f"stack({len(MEASURES)}, {', '.join(f"'{m.name}', {m.name}" for m in MEASURES)}) as (measure, value)"))
    return tall.groupBy("g_lang", "g_source", "measure", F.expr(_bin("value")).alias("value")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """The sketches of larger groups: counts of equal bins add up."""
    return sketch.groupBy(*by, "measure", "value").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """size, q10, q50, q90 by group and measure: least values with at least that share of the documents at or below."""
    w = Window.partitionBy(*by, "measure")
    ranked = sketch.withColumn("size", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda tenths: F.min(F.when(F.col("upto") * 10 >= F.col("size") * tenths, F.col("value")))
    return ranked.groupBy(*by, "measure").agg(F.max("size").alias("size"), at(1).alias("q10"), at(5).alias("q50"), at(9).alias("q90"))


def fences(sketch: DataFrame) -> DataFrame:
    """g_lang, g_source and the lowest and highest value allowed of each measure, from the narrowest group of MIN_GROUP documents."""
    own = quantiles(sketch, "g_lang", "g_source")
    lang = quantiles(merged(sketch, "g_lang"), "g_lang")
    # the measures' names stand for the group of all documents, so that no key is constant
    whole = quantiles(merged(sketch))
    q = lambda name, d, *by: d.select(*by, "measure", F.struct("size", "q10", "q50", "q90").alias(name))
    joined = q("own", own, "g_lang", "g_source").join(q("of_lang", lang, "g_lang"), ["g_lang", "measure"]).join(q("of_all", whole), ["measure"])
    chosen = F.when(F.col("own.size") >= MIN_GROUP, F.col("own")).when(F.col("of_lang.size") >= MIN_GROUP, F.col("of_lang")).otherwise(F.col("of_all"))
    joined = joined.select("g_lang", "g_source", "measure", chosen.alias("q"))
    out = []
    for m in MEASURES:
        mine = F.col("measure") == m.name
        out.append(F.max(F.when(mine, F.col("q.q50") + SPREAD * F.greatest(F.lit(m.least), F.col("q.q90") - F.col("q.q50")))).alias(f"{m.name}_max"))
        if m.both_sides:
            out.append(F.max(F.when(mine, F.col("q.q50") - SPREAD * F.greatest(F.lit(m.least), F.col("q.q50") - F.col("q.q10")))).alias(f"{m.name}_min"))
    return joined.groupBy("g_lang", "g_source").agg(*out)


def _join(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with their group's fences: broadcast while the groups are few, else by salted keys, as one group may hold a third of the rows."""
    keys = ["g_lang", "g_source"]
    if limits.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(limits), keys, "left")
    salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


def within() -> Column:
    ok = F.lit(True)
    for m in MEASURES:
        ok = ok & (F.col(m.name) <= F.col(f"{m.name}_max"))
        if m.both_sides:
            ok = ok & (F.col(m.name) >= F.col(f"{m.name}_min"))
    return ok


def judge(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per document row. lang and source choose the fences."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    measured = written(_measured(counts(rows)), "quality")
    limits = written(fences(sketches(measured)), "fences")
    kept = F.coalesce(~F.col("base_failed") & within(), F.lit(False))
    return _join(measured, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns and no others. Texts stay where they are: only counts are dealt anew."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    limits = written(fences(sketches(written(_measured(counts(rows, keep=("lang", "source"))), "quality"))), "fences")
    judged = _join(_measured(counts(rows, keep=("doc", "lang", "source"))), limits)
    return judged.where(F.coalesce(~F.col("base_failed") & within(), F.lit(False))).select("doc.*")
