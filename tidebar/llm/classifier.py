"""Quality classifier: ridge on random Fourier features of document statistics, calibrated by isotonic regression.

Each text is read once, for STATISTICS about its characters, words and lines,
which are written. Their means and deviations over all documents standardise
them. A fixed random projection and cosines approximate a Gaussian kernel;
every task sums the normal equations of its labelled rows by fold, and the
sums, FEATURES squared numbers a fold, are added in a tree. Each fold is scored by
the weights of the other folds; the penalty is that of the least such error,
and the isotonic curve is fitted on such scores, counted in BINS bins, so that
no row is judged by its own label. The final weights come from all folds.

What the driver holds doesn't grow with the documents: sums of the normal
equations, BINS counts, weights. Labels and ids are in no feature.

Defined cases: null and empty texts have statistics of zeros and are scored like
others; a null doc_id is held out (its text counts as empty); labels that are
neither 0 nor 1, or without an id, teach nothing, and several of one id count as
their mean; rows that repeat an id are learnt from and scored each; without any
label to learn from all scores are 0.5, with labels of one value near that value;
an empty table has no rows; texts of any length are read whole; other columns
take no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import fold, map_batches, written

HELD_OUT_OF, THRESHOLD = 5, 0.3
FOLDS, FEATURES, SEED = 4, 384, 11
#: Penalties by row that are tried.
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2)
#: Standard deviations beyond which a statistic counts as so many.
CLIP = 4.0
#: Bins of the scores that the isotonic curve is fitted on, and the scores they span.
BINS, SPAN = 4096, (-1.0, 2.0)
#: What the plain score weighs beside the curve, which is flat in places: documents there keep their order.
ORDER_WEIGHT = 1e-3

STATISTICS = (
    "bytes", "words", "word_bytes", "longest_word", "short_words", "upper", "digits", "symbols", "stops", "marks", "brackets", "spaces", "beyond_ascii",
    "entropy", "distinct_words", "repeated_triples", "repeated_lines", "line_bytes", "compressed",
)
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&|<>@^~_+=\\/", "stops": b".,;:", "marks": b"!?", "brackets": b"()[]{}\"'`", "spaces": b" \t\n\x0b\x0c\r", "beyond_ascii": bytes(range(128, 256))}
_KIND_OF = np.zeros((256, len(_KINDS)))
for _k, _chars in enumerate(_KINDS.values()):
    _KIND_OF[list(_chars), _k] = 1.0


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; shares go through a logarithm, as a few symbols tell more than many do."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, sizes = len(words), [len(x) for x in words]
    triples = Counter(zip(words, words[1:], words[2:]))
    part = lambda x, of: float(np.log(1e-3 + x / max(1, of)))
    kinds = [part(c, n) for c in counts @ _KIND_OF]
    longest = max(sizes, default=0)
    return [
        float(np.log1p(n)), float(np.log1p(w)), sum(sizes) / max(1, w), float(np.log1p(longest)), part(sum(s <= 3 for s in sizes), w), *kinds,
        float(-(share * np.log2(share)).sum()), len(set(words)) / max(1, w), part(sum(c for c in triples.values() if c > 1), w), part(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(1, len(lines)))), len(zlib.compress(raw, 1)) / n,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part (crc32 of the id) and the statistics of every document."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            values = [statistics(t) for t in b.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "part", "values"])

        return step

    crc = fold(F.col("doc_id"), 1 << 32)
    return map_batches(docs.select("doc_id", crc.alias("part"), "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, part long, values array<double>")


@dataclass(frozen=True)
class Features:
    """Standardised statistics to cosines: phi(x) . phi(y) is near exp(-|x - y|^2 / (2 * statistics))."""

    mean: np.ndarray
    deviation: np.ndarray

    def of(self, values: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = len(self.mean)
        turns = rng.normal(size=(d, FEATURES)) / np.sqrt(d)
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((values - self.mean) / self.deviation, -CLIP, CLIP)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ turns + shift), np.ones((len(x), 1))], axis=1)


def _values(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def features(stats: DataFrame) -> Features:
    """Means and deviations over all documents; a statistic that doesn't vary counts as 0."""
    each = [F.col("values")[k] for k in range(len(STATISTICS))]
    r = stats.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    mean, deviation = (np.array([x or 0.0 for x in part]) for part in (r[: len(each)], r[len(each) :]))
    return Features(mean, np.where(deviation > 1e-12, deviation, np.inf))


def taught(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, fold and label of the rows to learn from."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    mine = stats.where(F.col("part") % HELD_OUT_OF != 0).withColumn("fold", F.expr(f"part div {HELD_OUT_OF} % {FOLDS}"))
    return mine.join(known, "doc_id").select("fold", "label", "values")


def equations(rows: DataFrame, f: Features) -> np.ndarray:
    """(FOLDS, m + 1, m + 1): sums over each fold's rows of the products of features and label with each other."""
    width = FEATURES + 2

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, width, width))
        for b in batches:
            z = np.concatenate([f.of(_values(b.column(2))), b.column(1).to_numpy()[:, None]], axis=1)
            of = b.column(0).to_numpy()
            for k in np.unique(of):
                total[k] += z[of == k].T @ z[of == k]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    read = lambda r: np.frombuffer(r[0], np.float64)
    parts = rows.mapInArrow(summed, "sums binary").rdd.map(read)
    return parts.treeAggregate(np.zeros(FOLDS * width * width), np.add, np.add, 3).reshape(FOLDS, width, width)


def solve(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights; the constant is not penalised. The last sum is that of squared labels."""
    m = len(sums) - 1
    n = max(1.0, sums[m - 1, m - 1])  # the constant's square sums to the rows
    load = np.full(m, penalty * n)
    load[-1] = 1e-9 * n
    return np.linalg.solve(sums[:m, :m] + np.diag(load), sums[:m, m])


def _error(sums: np.ndarray, w: np.ndarray) -> float:
    """Sum of squared errors of weights over rows that are known by their sums."""
    m = len(w)
    return float(sums[m, m] - 2 * w @ sums[:m, m] + w @ sums[:m, :m] @ w)


def penalty_of(sums: np.ndarray) -> float:
    """The penalty of the least error on folds that the weights haven't seen."""
    total = sums.sum(axis=0)
    return min(PENALTIES, key=lambda p: sum(_error(sums[k], solve(total - sums[k], p)) for k in range(FOLDS)))


def isotonic(weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the rising curve of least squares through bins of weight rows whose labels sum to total (pool adjacent violators)."""
    at = np.flatnonzero(weight > 0)
    middle = SPAN[0] + (at + 0.5) * (SPAN[1] - SPAN[0]) / BINS
    pools: list[list[float]] = []  # weight, sum of labels, sum of places
    for n, s, x in zip(weight[at], total[at], middle * weight[at], strict=True):
        pools.append([n, s, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


@dataclass(frozen=True)
class Model:
    features: Features
    weights: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        if not len(self.places):
            return np.full(len(values), 0.5)
        plain = self.features.of(values) @ self.weights
        curve = np.interp(plain, self.places, self.values)
        order = np.clip((plain - SPAN[0]) / (SPAN[1] - SPAN[0]), 0, 1)
        return (1 - ORDER_WEIGHT) * curve + ORDER_WEIGHT * order


def train(stats: DataFrame, labels: DataFrame) -> Model:
    f = features(stats)
    rows = written(taught(stats, labels), "taught")
    sums = equations(rows, f)
    total = sums.sum(axis=0)
    if total[-2, -2] == 0:
        return Model(f, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    best = penalty_of(sums)
    others = np.stack([solve(total - sums[k], best) for k in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            plain = (f.of(_values(b.column(2))) * others[b.column(0).to_numpy()]).sum(axis=1)
            at = np.clip((plain - SPAN[0]) / (SPAN[1] - SPAN[0]) * BINS, 0, BINS - 1).astype(np.int64)
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, b.column(1).to_numpy(), BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at]), pa.array(s[at])], ["bin", "n", "s"])

    counts = rows.mapInArrow(binned, "bin long, n double, s double").groupBy("bin").agg(F.sum("n"), F.sum("s")).collect()
    weight, labelled = np.zeros(BINS), np.zeros(BINS)
    for at, n, s in counts:
        weight[at], labelled[at] = n, s
    return Model(f, solve(total, best), *isotonic(weight, labelled))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = written(measured(docs), "statistics")
    model = train(stats, labels)

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            score = np.round(model.score(_values(b.column(2))), 9)
            held = b.column(1).to_numpy() % HELD_OUT_OF == 0
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return step

    return map_batches(stats, make, f"doc_id {dict(stats.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
