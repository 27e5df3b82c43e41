"""Hard negatives by product quantisation with stored residual norms: bounds filter, integers decide.

Vectors become whole numbers, floor(256 * x). Every row is stored with its
product-quantisation code (one centroid for each pair of components) and the
norm of what each centroid leaves over. For an anchor a, a table of its products
with all centroids gives a row's approximate score by lookups, and by the
inequality of Cauchy and Schwarz the exact score is within
sum over pairs of |a_pair| * |residual_pair| of it. A row whose bounds show that
it can't be among an anchor's first positives, or in a window below one of them,
is passed over; all others are scored exactly in integers. So the codebooks,
fitted on a bounded sample, decide the speed alone and never the result.

Anchors are searched against all rows, in blocks: BLOCK anchors at a time are
sent to the tasks (a few MB, whatever the table's size), and every task reads
its share of the coded rows once for the positives and once for the windows,
keeping 5 and then 3 rows for each anchor and window. Tasks are at most
PARTS_PER_CORE a core, so that what they hand on grows with the anchors alone.
A third of all rows with one vector is so many more exact scores and no more rows.

Defined cases: rows whose id, label or vector is null, or with a null or
non-finite component, take no part; a vector shorter than the longest counts as
ended by zeros, an empty one is the zero vector; rows of one id that score alike
count once, others by their own scores; an anchor id that is repeated is its row
of the least label and vector; rows of the anchor's own id are no others of it;
a score beyond a long is the nearest long; an empty table, or one without
anchors, has no rows; extra columns take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.common import shared_dir, written

ANCHORS_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score in hundredths of its positive's.
LEAST, MOST = 50, 95
#: Components of a subspace, and centroids of one: codes are bytes.
WIDTH, CENTROIDS = 2, 256
#: Rows that the codebooks are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 8192, 6
#: Anchors sent to the tasks at once, anchors and rows scored at once.
BLOCK, ANCHORS_AT_ONCE, ROWS_AT_ONCE = 4096, 256, 8192
PARTS_PER_CORE = 2
LONG = 2**63 - 1

CODED = "vec_id long, label int, vector binary, code binary, norms binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part: labels shifted, components as whole numbers."""
    x = F.col("embedding")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~broken)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long"), label.cast("int").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vector"))


def _matrix(vectors: pa.ListArray, d: int) -> np.ndarray:
    """(rows, d), zeros after a vector's end."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), d), dtype=np.int64)
    out[np.arange(d) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _split(x: np.ndarray) -> np.ndarray:
    """(subspaces, rows, WIDTH), the last subspace ended by zeros."""
    x = np.pad(x.astype(np.float64), ((0, 0), (0, -x.shape[1] % WIDTH)))
    return x.reshape(len(x), x.shape[1] // WIDTH, WIDTH).transpose(1, 0, 2)


def _nearest(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, subspaces) codes."""
    out = np.empty((parts.shape[1], len(books)), dtype=np.uint8)
    for m, book in enumerate(books):
        out[:, m] = np.argmin((book * book).sum(axis=1) - 2 * (parts[m] @ book.T), axis=1)
    return out


def fit(sample: np.ndarray, seed: int = 1) -> np.ndarray:
    """Codebooks (subspaces, CENTROIDS, WIDTH) by Lloyd's rounds over a sample; with few rows centroids repeat."""
    rng, parts = np.random.default_rng(seed), _split(sample)
    books = parts[:, rng.choice(len(sample), CENTROIDS, replace=len(sample) < CENTROIDS)].copy()
    for _ in range(ROUNDS):
        codes = _nearest(parts, books)
        for m in range(len(books)):
            n = np.bincount(codes[:, m], minlength=CENTROIDS)
            sums = np.stack([np.bincount(codes[:, m], parts[m][:, k], CENTROIDS) for k in range(WIDTH)], axis=1)
            books[m][n > 0] = sums[n > 0] / n[n > 0, None]
    return books


def codebooks(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """fit() on the SAMPLE rows of the least hashes; only rows below a hash that about twice as many pass are sorted."""
    place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40))
    some = rows.where(place < (1 << 40) * min(1.0, 2 * SAMPLE / n)).orderBy(place, "vec_id").limit(SAMPLE)
    found = [r[0] for r in some.select("vector").collect()]
    return fit(_matrix(pa.array(found or [[]], pa.list_(pa.int64())), d))


def coded(rows: DataFrame, books: np.ndarray, d: int) -> DataFrame:
    """Rows with their codes and the norms of their residuals, a little above the exact ones."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), d)
            parts = _split(x)
            codes = _nearest(parts, books)
            rest = np.stack([parts[m] - books[m][codes[:, m]] for m in range(len(books))], axis=1) if len(books) else np.zeros((len(x), 0, WIDTH))
            norms = np.sqrt((rest * rest).sum(axis=2)) * (1 + 1e-12)
            as_bytes = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_bytes(x), as_bytes(codes), as_bytes(norms)], ["vec_id", "label", "vector", "code", "norms"])

    return rows.mapInArrow(encode, CODED)


@dataclass
class Rows:
    """Coded rows of one scoring step."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(batches: list[pa.RecordBatch], d: int) -> Rows:
        t = pa.Table.from_batches(batches)
        read = lambda name, kind, width: np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(-1, width)
        m = -(-d // WIDTH)
        n = t.num_rows
        if not d:
            return Rows(t["vec_id"].to_numpy(), t["label"].to_numpy(), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.uint8), np.zeros((n, 0)))
        return Rows(t["vec_id"].to_numpy(), t["label"].to_numpy(), read("vector", np.int64, d), read("code", np.uint8, m), read("norms", np.float64, m))

    def first(self) -> np.ndarray:
        """The first row of each id: bounds of the others may not count twice."""
        out = np.zeros(len(self.ids), dtype=bool)
        out[np.unique(self.ids, return_index=True)[1]] = True
        return out


def stepped(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[Rows]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= ROWS_AT_ONCE:
            yield Rows.of(held, d)
            held = []
    if held:
        yield Rows.of(held, d)


def bounds(anchors: np.ndarray, rows: Rows, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores (anchors, rows), by lookups and residual norms."""
    parts = _split(anchors)
    about = np.zeros((len(anchors), len(rows.ids)))
    for m, book in enumerate(books):
        about += np.take(parts[m] @ book.T, rows.codes[:, m], axis=1)
    own = np.sqrt((parts * parts).sum(axis=2)).T
    off = own @ rows.norms.T
    # what floating sums can be off by: far less than a millionth of the norms' product
    size = np.sqrt((rows.vectors.astype(np.float64) ** 2).sum(axis=1)) + rows.norms.sum(axis=1)
    off += 1e-9 * np.sqrt((own * own).sum(axis=1))[:, None] * size + 1e-6
    return about - off, about + off


def exact(anchors: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (i, j)."""
    out = np.empty(len(i), dtype=np.int64)
    most = [int(np.abs(x.astype(np.float64)).max(initial=0.0)) for x in (anchors, vectors)]
    plain = most[0] * most[1] * max(1, anchors.shape[1]) < 2**62
    for b in range(0, len(i), 1 << 16):
        x, y = anchors[i[b : b + (1 << 16)]], vectors[j[b : b + (1 << 16)]]
        if plain:
            out[b : b + len(x)] = np.einsum("ij,ij->i", x, y)
        else:  # beyond 64 bits: Python's integers
            out[b : b + len(x)] = [max(-LONG, min(LONG, s)) for s in (sum(p * q for p, q in zip(u, v, strict=True)) for u, v in zip(x.tolist(), y.tolist(), strict=True))]
    return out


class Best:
    """The k first (score, id) of each list, and the score that a new one must reach."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.list, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(lists, -np.inf)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        a, s, n = (np.concatenate([x, y]) for x, y in ((self.list, lists), (self.score, scores), (self.id, ids)))
        order = np.lexsort((n, -s, a))
        a, s, n = a[order], s[order], n[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
        a, s, n = a[new], s[new], n[new]
        begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(a)) - np.repeat(begins, np.diff(np.r_[begins, len(a)]))
        keep = place < self.k
        self.list, self.score, self.id = a[keep], s[keep], n[keep]
        full = place == self.k - 1
        self.least[a[full]] = s[full]


def _pieces(n: int) -> Iterator[slice]:
    for b in range(0, n, ANCHORS_AT_ONCE):
        yield slice(b, min(n, b + ANCHORS_AT_ONCE))


def best_positives(rows: Rows, anchors: Rows, books: np.ndarray, best: Best) -> None:
    """Takes a step's rows into each anchor's first positives."""
    k, first = best.k, rows.first()
    for at in _pieces(len(anchors.ids)):
        low, up = bounds(anchors.vectors[at], rows, books)
        same = (anchors.labels[at][:, None] == rows.labels) & (anchors.ids[at][:, None] != rows.ids)
        least = best.least[at]
        if len(rows.ids) > k:
            sure = np.where(same & first, low, -np.inf)
            least = np.maximum(least, np.partition(sure, len(rows.ids) - k, axis=1)[:, len(rows.ids) - k])
        i, j = np.nonzero(same & (up >= least[:, None]))
        best.add(i + at.start, exact(anchors.vectors[at], rows.vectors, i, j), rows.ids[j])


def best_negatives(rows: Rows, anchors: Rows, books: np.ndarray, windows: tuple[np.ndarray, np.ndarray], best: Best) -> None:
    """Takes a step's rows into the windows (from, to; anchors by POSITIVES) of each anchor."""
    begin, end = windows
    for at in _pieces(len(anchors.ids)):
        low, up = bounds(anchors.vectors[at], rows, books)
        other = anchors.labels[at][:, None] != rows.labels
        other &= anchors.ids[at][:, None] != rows.ids
        must = np.maximum(begin[at].astype(np.float64), best.least.reshape(-1, POSITIVES)[at])
        may = np.zeros_like(other)
        for w in range(POSITIVES):
            may |= (up >= must[:, w : w + 1]) & (low <= end[at][:, w : w + 1])
        i, j = np.nonzero(may & other)
        scores, ids = exact(anchors.vectors[at], rows.vectors, i, j), rows.ids[j]
        for w in range(POSITIVES):
            inside = (scores >= begin[at][i, w]) & (scores <= end[at][i, w])
            best.add((i[inside] + at.start) * POSITIVES + w, scores[inside], ids[inside])


def _found(ids: np.ndarray, best: Best, per: int, schema: list[str]) -> pa.RecordBatch:
    columns = [ids[best.list // per], best.list % per, best.id, best.score]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema)


def _windows(anchors: Rows, positives: list) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores of the windows; without a positive a window is empty."""
    begin, end = (np.full((len(anchors.ids), POSITIVES), x, dtype=np.int64) for x in (LONG, -LONG))
    at = {int(a): i for i, a in enumerate(anchors.ids)}
    for anchor, place, score in positives:
        begin[at[anchor], place], end[at[anchor], place] = -(-LEAST * score // 100), MOST * score // 100
    return begin, end


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = written(valid(embeddings), "vectors")
    n, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    books = codebooks(rows, n, d)
    table = written(coded(rows, books, d), "coded").coalesce(PARTS_PER_CORE * spark.sparkContext.defaultParallelism)
    anchors = table.where(F.col("vec_id") % ANCHORS_EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "code", "norms")).alias("r")).select("vec_id", "r.*")
    anchors = written(anchors, "anchors")
    out, last = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}", None
    while True:
        rest = anchors if last is None else anchors.where(F.col("vec_id") > last)
        block = rest.orderBy("vec_id").limit(BLOCK).collect()
        if not block:
            break
        last = block[-1][0]
        _mined(table, block, books, d).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out) if last is not None else spark.createDataFrame([], RESULT)


def _mined(table: DataFrame, block: list, books: np.ndarray, d: int) -> DataFrame:
    """The result of one block of anchors."""
    arrow = pa.RecordBatch.from_arrays([pa.array([r[k] for r in block], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["vec_id", "label", "vector", "code", "norms"])
    anchors = Rows.of([arrow], d)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.ids), POSITIVES)
        for step in stepped(batches, d):
            best_positives(step, anchors, books, best)
        yield _found(anchors.ids, best, 1, ["anchor_id", "list", "positive_id", "positive_score"])

    made = table.mapInArrow(positives, "anchor_id long, list long, positive_id long, positive_score long").drop("list").distinct()
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")  # over 5 rows a task at most
    chosen = written(made.withColumn("place", F.row_number().over(first) - 1).where(F.col("place") < POSITIVES), "positives")
    windows = _windows(anchors, [tuple(r) for r in chosen.select("anchor_id", "place", "positive_score").collect()])

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.ids) * POSITIVES, NEGATIVES)
        for step in stepped(batches, d):
            best_negatives(step, anchors, books, windows, best)
        yield _found(anchors.ids, best, POSITIVES, ["anchor_id", "place", "negative_id", "negative_score"])

    low = table.mapInArrow(negatives, "anchor_id long, place long, negative_id long, negative_score long").distinct()
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")))
    return ranked.where(F.col("rank") <= NEGATIVES).join(chosen, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
