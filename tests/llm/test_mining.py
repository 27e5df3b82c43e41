"""Hard negatives against every pair, and the bounds against exact scores."""

import math

import duckdb
import numpy as np
import pytest

from tidebar.llm import mining, queries
from tidebar.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        kept.setdefault(i, set()).add((y, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in (i for i in kept if i % 50 == 0):
        label, x = min(kept[a])
        scored = {(sum(p * q for p, q in zip(x, z)), i, y) for i, found in kept.items() if i != a for y, z in found}
        positives = sorted({(-s, i) for s, i, y in scored if y == label})[:5]
        for s, p in positives:
            window = sorted({(-n, i) for n, i, y in scored if y != label and 50 * -s <= 100 * n <= 95 * -s})[:3]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(window)]
    return sorted(out)


def mined(spark, rows):
    return sorted(map(tuple, mining.mine(spark.createDataFrame(rows, SCHEMA)).collect()))


@pytest.mark.parametrize("d", [1, 7, 16])
def test_against_every_pair(spark, monkeypatch, d):
    monkeypatch.setattr(mining, "BLOCK", 3)
    monkeypatch.setattr(mining, "ANCHORS_AT_ONCE", 2)
    monkeypatch.setattr(mining, "ROWS_AT_ONCE", 64)
    rng = np.random.default_rng(d)
    middle = rng.normal(size=(3, d)) * 0.3
    rows = [(i, [float(x) for x in middle[i % 3] + rng.normal(size=d) * 0.3], int(rng.integers(0, 3))) for i in range(0, 420, 2)]
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 20


def test_one_vector_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(mining, "ROWS_AT_ONCE", 50)
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else [float(x) for x in rng.random(3)], int(rng.integers(0, 2))) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.random(4)], i % 2) for i in range(120)]
    rows += [(200, None, 1), (None, [1.0] * 4, 1), (250, [1.0] * 4, None), (300, [1.0, None, 0.0, 0.0], 1), (301, [float("nan")] * 4, 1), (302, [float("inf"), 0.0, 0.0, 0.0], 0)]
    rows += [(350, [], 1), (351, [0.5], 1), (352, [0.5, 0.5, 0.5, 0.5, 9.0], 0), (400, [-1.0, -1.0], 1), (50, [0.9] * 4, 0)]
    rows += [rows[3]] * 30 + [rows[50]] * 4 + [(100, [0.8] * 4, 1), (4, [0.1] * 4, 0)]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_a_long_and_empty_tables(spark):
    rows = [(0, [1e12, 1e12], 1), (1, [1e12, 1e12], 0), (2, [7e11, 7e11], 0), (3, [1e12, 9e11], 1)]
    want = [(a, p, k, n, s, min(t, mining.LONG)) for a, p, k, n, s, t in brute(rows)]
    assert all(t[4] <= mining.LONG for t in mined(spark, rows)) and len(want) <= 3
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [], 1), (2, [], 1)]) == []
    extra = spark.createDataFrame([(0, [1.0, 0.0], 1, "x", 1), (1, [1.0, 0.0], 2, "y", 2), (2, [1.0, 0.1], 2, "z", 3), (3, [0.6, 0.0], 3, "z", 3)], f"{SCHEMA}, code string, rank int")
    assert sorted(map(tuple, mining.mine(extra).collect())) == brute([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.1], 2), (3, [0.6, 0.0], 3)])


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(3000, 16)) * 100).astype(np.int64)
    books = mining.fit(x[:2000])
    parts = mining._split(x)
    codes = mining._nearest(parts, books)
    rest = np.stack([parts[m] - books[m][codes[:, m]] for m in range(len(books))], axis=1)
    rows = mining.Rows(np.arange(3000), np.zeros(3000), x, codes, np.sqrt((rest * rest).sum(axis=2)) * (1 + 1e-12))
    low, up = mining.bounds(x[:40], rows, books)
    scores = x[:40] @ x.T
    assert (low <= scores).all() and (scores <= up).all()
    assert (up - low).mean() < scores.std()  # narrower than what it has to tell apart
    best = mining.Best(40, 5)
    mining.best_positives(rows, mining.Rows(np.arange(40), np.zeros(40), x[:40], codes[:40], rows.norms[:40]), books, best)
    assert sorted(best.score[best.list == 7].tolist()) == sorted(np.delete(scores[7], 7).tolist())[-5:]


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_hard_negatives"])
    got = queries.op12_hard_negatives(spark, sf)
    assert got.columns == [c[0] for c in want.description]
    found = sorted(want.fetchall())
    assert sorted(map(tuple, got.collect())) == found and found
    assert brute([tuple(r) for r in table(spark, sf, "embeddings").collect()]) == found
