r"""URL filters: host and path rules, and boosted trees on lexical features for the rest.

Native: features, labels and scores are DataFrame expressions. The labelled
URLs are those that a rule decides. At most SAMPLE_ROWS of them, those with the
least hashes of id and url, are fitted by gradient boosting (logistic loss,
Newton leaves) on binned features; the trees become one CASE expression that
judges every URL no rule fits. Statistics of suffixes count all URLs and all
suffixes, summed over SUFFIX_GROUPS hashes of a suffix.

Defined cases: a null url and one without `://` have empty host and path and
the features of an empty text; repeated rows are judged alike; where no URL is
labelled, or all alike, the model says what the labels say (allow if there are
none); an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import ascii_lower

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Bound of the sample that the classifier is fitted on.
SAMPLE_ROWS = 8192
#: Hash groups of suffixes (last host labels) whose counts are features.
SUFFIX_GROUPS = 1024
TREES, DEPTH, BINS, RATE, RIDGE = 24, 3, 16, 0.3, 1.0


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: str
    most: int  # goes low where the feature is at most this
    low: Split | Leaf
    high: Split | Leaf


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path: null where there is no url or no ://, then made empty."""
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def entropy(said: Column) -> Column:
    """Bits a character, over all characters that occur: runs of the sorted characters are their counts."""
    step = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    fresh = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    more = lambda a, c: F.when(c == a["c"], F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1).alias("n"), (a["s"] + step(a["n"])).alias("s")))
    letters = F.array_sort(F.filter(F.split(said, ""), lambda c: c != ""))
    return F.when(F.length(said) > 0, F.log2(F.length(said)) - F.aggregate(letters, fresh, more, lambda a: a["s"] + step(a["n"])) / F.length(said)).otherwise(F.lit(0.0))


def features(url: Column, host: Column, path: Column, suffix_count: Column) -> dict[str, Column]:
    """Whole numbers, so that split points are exact."""
    text = F.coalesce(url, F.lit(""))
    said = F.concat(host, path)
    chars = F.length(said)
    labels = F.split(host, r"\.")
    digits = F.regexp_count(said, F.lit("[0-9]"))
    query = F.regexp_extract(text, r"(?s)\A[^?#]*\?([^#]*)", 1)
    return {
        "url_length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/")),
        "host_labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "digits": digits,
        "digit_share": (1000 * digits / F.greatest(F.lit(1), chars)).cast("int"),
        "entropy": (100 * entropy(said)).cast("int"),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": text.contains("#").cast("int"),
        "secure": text.startswith("https:").cast("int"),
        "suffix_length": F.length(F.element_at(labels, -1)),
        "suffix_count": suffix_count,
    }


def rule_text(host: str, path: str) -> str:
    return host + path


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(rule_text(r[0], r[1])), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(rule_text(h, p))).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _prepared(pages: DataFrame, rules, id_col: str, url_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return rows.select("*", rule.alias("rule"), verdict.alias("said"), F.pmod(F.xxhash64(F.element_at(F.split("host", r"\."), -1)), F.lit(SUFFIX_GROUPS)).cast("int").alias("suffix_group"))


def _suffix_count(counts: dict[int, int]) -> Column:
    """Half the log2 steps of the count of a suffix's group."""
    steps = [round(2 * math.log2(1 + counts.get(k, 0))) for k in range(SUFFIX_GROUPS)]
    return F.element_at(F.array(*map(F.lit, steps)), F.col("suffix_group") + 1)


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """The SAMPLE_ROWS labelled rows (of `rows`) of least hashes. Only hashes below a bound that about twice as many pass are sorted, whatever the number of tasks."""
    if rows > 4 * SAMPLE_ROWS:
        least = -(1 << 63)
        labelled = labelled.where(F.col("h") < least + (1 << 64) * 2 * SAMPLE_ROWS // rows)
    return labelled.orderBy("h", "url", "page_id").limit(SAMPLE_ROWS)


def _bins(values: list[int]) -> list[int]:
    """Split points: halfway from up to BINS quantiles of the rows' values to the next larger value."""
    ordered, distinct = sorted(values), sorted(set(values))
    after = dict(zip(distinct, distinct[1:], strict=False))
    return sorted({(v + after[v]) // 2 for k in range(BINS) if (v := ordered[len(ordered) * k // BINS]) in after})


def fit(rows: list[tuple[tuple[int, ...], int]], names: list[str], *, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[Split | Leaf]]:
    """Prior log-odds and trees for (features, label) rows; rows of equal binned features are one with a weight."""
    positive, n = sum(y for _, y in rows), len(rows)
    prior = math.log((positive + 0.5) / (n - positive + 0.5)) if n else -20.0
    if not 0 < positive < n:
        return (prior if n else -20.0), []
    points = [_bins([x[f] for x, _ in rows]) for f in range(len(names))]
    weights: dict[tuple[int, ...], list[int]] = {}
    for x, y in rows:
        key = tuple(sum(v > p for p in points[f]) for f, v in enumerate(x))
        w = weights.setdefault(key, [0, 0])
        w[0] += 1
        w[1] += y
    keys = sorted(weights)
    total, ones = [weights[k][0] for k in keys], [weights[k][1] for k in keys]
    score = [prior] * len(keys)

    def grow(members: list[int], g: list[float], h: list[float], level: int) -> Split | Leaf:
        sg, sh = sum(g[i] for i in members), sum(h[i] for i in members)
        best = (1e-6, -1, -1)
        if level:
            for f in range(len(names)):
                bg, bh = [0.0] * (len(points[f]) + 1), [0.0] * (len(points[f]) + 1)
                for i in members:
                    b = keys[i][f]
                    bg[b] += g[i]
                    bh[b] += h[i]
                lg = lh = 0.0
                for b in range(len(points[f])):
                    lg, lh = lg + bg[b], lh + bh[b]
                    gain = lg * lg / (lh + RIDGE) + (sg - lg) ** 2 / (sh - lh + RIDGE) - sg * sg / (sh + RIDGE)
                    best = max(best, (gain, -f, -b), key=lambda x: x[0])
        if best[0] <= 1e-6:
            value = RATE * sg / (sh + RIDGE)
            for i in members:
                score[i] += value
            return Leaf(value)
        f, b = -best[1], -best[2]
        low, high = [i for i in members if keys[i][f] <= b], [i for i in members if keys[i][f] > b]
        return Split(names[f], points[f][b], grow(low, g, h, level - 1), grow(high, g, h, level - 1))

    found: list[Split | Leaf] = []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [ones[i] - total[i] * p[i] for i in range(len(keys))]
        h = [total[i] * p[i] * (1 - p[i]) for i in range(len(keys))]
        found.append(grow(list(range(len(keys))), g, h, depth))
    return prior, found


def tree_sql(node: Split | Leaf) -> str:
    if isinstance(node, Leaf):
        return f"{node.value!r}D"
    return f"CASE WHEN {node.feature} <= {node.most} THEN {tree_sql(node.low)} ELSE {tree_sql(node.high)} END"


def classify(pages: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of a block), one row per page row."""
    rows = _prepared(pages, rules, id_col, url_col)
    groups = rows.groupBy("suffix_group").agg(F.count("*").alias("n"), F.count("rule").alias("ruled")).collect()
    named = features(F.col("url"), F.col("host"), F.col("path"), _suffix_count({r["suffix_group"]: r["n"] for r in groups}))
    rows = rows.select("page_id", "host", "path", "rule", "said", F.coalesce("url", F.lit("")).alias("url"), *[c.cast("int").alias(n) for n, c in named.items()])
    label = (F.col("said") == "block").cast("int").alias("label")
    labels = rows.where("rule is not null").select(*named, label, F.xxhash64("page_id", "url").alias("h"), "url", "page_id")
    sample = _sample(labels, sum(r["ruled"] for r in groups))
    labelled = [(tuple(r[n] for n in named), r["label"]) for r in sample.collect()]
    prior, trees = fit(labelled, list(named))
    z = F.expr(" + ".join([f"{prior!r}D", *map(tree_sql, trees)]))
    rows = rows.select("page_id", "host", "path", "rule", "said", (1 / (1 + F.exp(-z))).alias("score"))
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
