"""The quality classifier: held-out accuracy, and its parts against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import classifier, queries
from tidebar.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    n = (label == 1).sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_quality_classifier(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[r.doc_id], r.quality) for r in table(spark, sf, "labels").collect() if rows[r.doc_id].held_out]
    label = np.array([q for _, q in held])
    assert auc(np.array([r.score for r, _ in held]), label) > 0.97
    right = np.array([r.predicted for r, _ in held]) == label
    assert right[label == 1].mean() > 0.98 and right[label == 0].mean() > 0.8


def test_labels_of_held_out_documents_and_other_columns_teach_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "values": F.lit("v"), "part": F.lit(1)})
    assert sorted(map(tuple, classifier.classify(changed, other).collect())) == sorted(map(tuple, classifier.classify(docs, labels).collect()))


def test_sums_and_weights_against_plain_least_squares(spark):
    rng = np.random.default_rng(1)
    d = len(classifier.STATISTICS)
    x, y = rng.normal(size=(200, d)), rng.integers(0, 2, 200).astype(float)
    rows = [(int(k), float(label), [float(v) for v in r]) for k, label, r in zip(rng.integers(0, 4, 200), y, x)]
    f = classifier.Features(x.mean(axis=0), x.std(axis=0))
    sums = classifier.equations(spark.createDataFrame(rows, "fold long, label double, values array<double>").repartition(3), f)
    z = f.of(x)
    for k in range(4):
        one = np.array([r[0] == k for r in rows])
        both = np.concatenate([z[one], y[one, None]], axis=1)
        assert np.allclose(sums[k], both.T @ both)
    total, penalty = sums.sum(axis=0), 1e-3
    load = np.full(z.shape[1], np.sqrt(penalty * 200))
    load[-1] = np.sqrt(1e-9 * 200)
    plain = np.linalg.lstsq(np.concatenate([z, np.diag(load)]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(z @ classifier.solve(total, penalty), z @ plain, atol=1e-6)
    assert np.isclose(classifier._error(total, plain), ((z @ plain - y) ** 2).sum())


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    d = len(classifier.STATISTICS)
    x = rng.normal(size=(60, d))
    z = classifier.Features(np.zeros(d), np.ones(d)).of(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * d))
    assert np.abs(z @ z.T - kernel).max() < 0.25 and np.abs(z @ z.T - kernel).mean() < 0.05


def test_isotonic_against_the_min_max_formula():
    rng = np.random.default_rng(4)
    at = np.sort(rng.choice(classifier.BINS, 40, replace=False))
    n, s = np.zeros(classifier.BINS), np.zeros(classifier.BINS)
    n[at] = rng.integers(1, 9, 40)
    s[at] = np.minimum(n[at], rng.integers(0, 9, 40))
    places, values = classifier.isotonic(n, s)
    assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all()
    means = [max(min(s[at[i : j + 1]].sum() / n[at[i : j + 1]].sum() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(np.unique(np.round(means, 12)), np.unique(np.round(values, 12)))


@pytest.mark.parametrize("text", ["", " ", "\n", "a", "Ünï 中文 \U0001f600", "!!!" * 1000, "x" * 2_000_000, "one two " * 200_000])
def test_statistics_are_finite(text):
    found = classifier.statistics(text)
    assert len(found) == len(classifier.STATISTICS) and np.isfinite(found).all()


def test_nulls_repeats_and_tables_without_labels(spark):
    random.seed(1)
    rows = [(i, None if i % 7 == 0 else "word " * random.randint(0, 40) + "!#" * (i % 3), "en", None, 1) for i in range(60)] + [(None, "x y", None, "s", None)] * 3 + [(4, "again", "en", "s", 1)] * 5
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(4, 1, 0), (5, None, 0), (6, 7, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id is None}) == 1 and all(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in classifier.classify(docs, labels.where("false")).collect()} == {0.5}
    ones = classifier.classify(docs, labels.withColumn("quality", F.lit(1))).collect()
    assert min(r.score for r in ones) > 0.9
    assert classifier.classify(docs.where("false"), labels).collect() == []
