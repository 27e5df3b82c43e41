"""The manifest against a plain recursive version, and what tampering does to proofs."""

import hashlib
import zlib

import duckdb
import pytest

from tidebar.llm import merkle, queries
from tidebar.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    said = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said)


def tree(nodes):
    """The root, and the steps (before, after) of each node."""
    steps = [[] for _ in nodes]
    above = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, below in enumerate(above):
            run, slot = runs[i // 16], i % 16
            for x in below:
                steps[x].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        above = [sum(above[i : i + 16], []) for i in range(0, len(above), 16)]
        nodes = [h(r) for r in runs]
    return nodes[0], steps


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, over = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, over):
        sub, steps = trees[s]
        for (_, _, original, r), own in zip(sorted(by[s], key=lambda x: x[:3]), steps):
            path, text = own + top, r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for before, after in path:
                folded = h((before, folded, after))
            out.append((r["doc_id"], original, sub, root, h(x for p in path for x in p), folded, folded == root))
    return out


def found(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    return sorted(map(tuple, merkle.manifest(df).collect()), key=str)


def doc(doc_id, source="a", text="Some Text", lang="en", n_chars=9):
    return {"doc_id": doc_id, "source": source, "text": text, "lang": lang, "n_chars": n_chars}


@pytest.mark.parametrize("sizes", [(1,), (16,), (17,), (1, 2, 300), (257, 1, 16), (1,) * 20])
def test_shapes_of_trees(spark, sizes):
    rows = [doc(1000 * k + i * 3, f"s{k}", f"Text {i} of {k}") for k, n in enumerate(sizes) for i in range(n)]
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_nulls_ties_copies_and_empty_texts(spark):
    rows = [doc(None, None), doc(None, None), doc(None, None), doc(5, None, None), doc(5, "a", ""), doc(5, "a", ""), doc(5, "a", "Other"), doc(-3, "é", "Ünï"), doc(7, "", "x", None, None), doc(8, "Z", "A" * 1_000_000)]
    rows += [doc(9, "a", "same")] * 40
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).collect() == [] and merkle.manifest(empty).columns == [f.split()[0] for f in merkle.RESULT.split(", ")]
    rows = [doc(i, f"s{i % 3}") for i in range(50)]
    df = spark.createDataFrame([(*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), "x", 1, 2, 3) for r in rows], f"{SCHEMA}, leaf string, index int, tree int, width int")
    assert sorted(map(tuple, merkle.manifest(df).collect()), key=str) == sorted(brute(rows), key=str)


def test_query_against_brute_force_and_sql(spark, sf):
    got = queries.op13_merkle_manifest(spark, sf).collect()
    want = brute([r.asDict() for r in table(spark, sf, "documents").collect()])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(not r.verified for r in got) and sum(r.verified for r in got) > len(got) / 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op13_merkle_manifest"])
    assert [c[0] for c in cur.description] == merkle.manifest(spark.createDataFrame([], SCHEMA)).columns
    assert sorted(cur.fetchall(), key=str) == sorted(map(tuple, got), key=str)


def test_a_missing_child_is_found():
    with pytest.raises(ValueError):
        merkle._completed(((0, 0), [(0, "a", 3), (1, "b", 3)]))
