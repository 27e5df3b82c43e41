"""Merkle manifest of a table of documents, with a membership proof of every row, by message-passing supersteps.

A row's leaf is a hash of all its columns. The leaves of a source, in order of
doc_id, are the bottom of the source's tree; every 16 consecutive nodes have one
parent, whose digest is the hash of theirs. The sources' roots, in order of the
sources, are the bottom of the top tree.

Superstep k upwards: nodes of level k send (slot, digest, width of the level) to
their parents; a parent that has as many messages as the width says it has
children is complete, hashes them and sends on. A source's last node sends into
the top tree. Downwards: a node that knows its path to the root sends each child
the path with the child's siblings put before it, down to the runs of leaves.
A run's 16 leaves share the path above them, so that what is sent is the path of
a run and not of a leaf: about 60 bytes a leaf and level.

Leaves are hashed once and written; texts are in no shuffle. Numbering a source
range-partitions by (source, doc_id, leaf), so that a source of a third of all
rows is spread over tasks, and adds the counts of the parts before. What the
driver learns is two numbers: the most leaves of a source and the number of
sources. Lost tasks are recomputed from the leaves' table and shuffle files.

Defined cases: nulls in any column hash as `-`; an empty text is `0:`; rows that
repeat an id are ordered by leaf, whole copies are leaves of their own; a null
doc_id comes first in its source and is never tampered with; an empty table has
no rows; columns beside the five take no part; a text of any length is hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.common import ascii_lower, fold, written

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree of the sources' roots; the others are numbered by their source's rank.
TOP = -1
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(c: Column) -> Column:
    """Length in UTF-8 bytes, a colon and the value; a dash for null. Texts are hashed as they are stored, without a check of their encoding."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in COLUMNS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, changed (the leaf after tampering, null where nothing is tampered with) and copy, which orders whole copies."""
    tampered = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) == 0)
    changed = F.when(tampered, leaf(ascii_lower(F.col("text"))))
    made = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), changed.alias("changed"))
    return written(made.withColumn("copy", F.monotonically_increasing_id()), "leaves")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with index from 0 within their group in order, and width, the group's rows. No task holds a group: parts of a range are counted, then numbered."""
    columns = rows.columns
    at, where = columns.index(group), pa.int64()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, place = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for key in batch.column(at).to_pylist():
                now, place = (key, place + 1) if key == now else (key, 0)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), where), pa.array(places, where)], [*columns, "part", "place"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "part long, place long"])
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(number, schema), "numbered")
    counts = parts.groupBy(group, "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)  # over the parts of a group, of which there are as many as partitions at most
    starts = counts.select(F.col(group).alias("_group"), F.col("part").alias("_part"), (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("_start"), F.sum("n").over(whole).alias("width"))
    met = parts.join(starts, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.select(*columns, (F.col("_start") + F.col("place")).alias("index"), "width")


def _children(index: int, width: int) -> int:
    return min(ARITY, width - ARITY * index)


def _above(width: int) -> int:
    return -(-width // ARITY)


def _completed(run: tuple) -> tuple:
    """((tree, index), (digest, width of its level, children's digests)) of a parent that has all its children's messages."""
    (tree, index), messages = run
    messages = sorted(messages)
    width = messages[0][2]
    if len(messages) != _children(index, width):
        raise ValueError(f"node {index} of tree {tree} has {len(messages)} children of {_children(index, width)}")
    digests = [m[1] for m in messages]
    return (tree, index), (digest(digests), _above(width), digests)


def _message(node: tuple) -> tuple:
    (tree, index), (hashed, width, *_) = node
    return (tree, index // ARITY), (index % ARITY, hashed, width)


def _is_root(node: tuple) -> bool:
    return node[1][1] == 1


def climb(nodes: RDD, widest: int, parts: int) -> tuple[list[RDD], RDD]:
    """Supersteps upwards from nodes ((tree, index), (digest, width)): the completed parents of each level, and the trees' roots."""
    levels, roots = [], nodes.filter(_is_root)
    while widest > 1:
        parts, widest = max(1, parts // 2), _above(widest)
        nodes = nodes.filter(lambda n: not _is_root(n)).map(_message).groupByKey(parts).map(_completed)
        levels.append(nodes)
        roots = roots.union(nodes.filter(_is_root))
    return levels, roots


def _siblings(digests: list[str], slot: int) -> tuple[str, str]:
    return "".join(digests[:slot]), "".join(digests[slot + 1 :])


def _sent(met: tuple) -> Iterator[tuple]:
    """A parent's path, with each child's siblings before it, to the children."""
    (tree, index), (parents, paths) = met
    for (_, _, digests), path in ((p, q) for p in parents for q in paths):
        for slot in range(len(digests)):
            yield (tree, ARITY * index + slot), (_siblings(digests, slot), *path)


def descend(levels: list[RDD], paths: RDD) -> RDD:
    """Reverse supersteps: paths of the roots to paths of all nodes of the lowest of levels' children. A path is ((before, after), ..) up to the root, and ends with what its root brought."""
    arrived = paths
    for parents in reversed(levels):
        # trees of other heights have their roots elsewhere: their paths wait for their level
        arrived = parents.cogroup(arrived, parents.getNumPartitions()).flatMap(lambda m: _sent(m) if len(m[1][0]) else [(m[0], p) for p in m[1][1]])
    return arrived


def _proved(run: tuple) -> Iterator[tuple]:
    """The result rows of a run of leaves that its path has reached; the only leaf of a tree has no run, and no step of its own."""
    members, paths = run[1]
    members = sorted(members, key=lambda m: m[0])
    digests = [m[1][1] for m in members]
    for path in paths:
        *above, (subroot, root) = path
        for slot, (doc_id, original, changed), width in members:
            steps = [_siblings(digests, slot), *above] if width > 1 else above
            folded = changed or original
            for before, after in steps:
                folded = digest((before, folded, after))
            yield doc_id, original, subroot, root, digest(x for s in steps for x in s), folded, folded == root


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    spark = docs.sparkSession
    made = numbered(leaves(docs), "source", ["doc_id", "leaf", "copy"])
    sources = made.groupBy("source").agg(F.max("width").alias("leaves"))
    ranks = numbered(sources.withColumn("all", F.lit(0)), "all", ["source"]).select(F.col("source").alias("_source"), F.col("index").alias("tree"), F.col("width").alias("trees"), "leaves")
    ranks = written(ranks, "sources")
    most = ranks.agg(F.max("leaves"), F.max("trees")).first()
    if most[0] is None:
        return spark.createDataFrame([], RESULT)
    placed = written(made.join(ranks, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "trees", "index", "width", "doc_id", "leaf", "changed"), "placed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # upwards: leaves, then the sources' roots
    bottom = placed.select("tree", "index", "leaf", "width").rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3])))
    levels, roots = climb(bottom, most[0], parts)
    trees = most[1]
    subroots = roots.map(lambda n: ((TOP, n[0][0]), (n[1][0], trees)))
    top, root = climb(subroots, trees, max(1, parts // 2))
    # downwards: the root's digest, then with it each source's own
    down = descend(top, root.map(lambda n: ((TOP, 0), (n[1][0],))))
    named = subroots.map(lambda n: (n[0], n[1][0])).cogroup(down, max(1, parts // 2))
    into = named.flatMap(lambda m: [((m[0][1], 0), (*path[:-1], (sub, path[-1]))) for sub in m[1][0] for path in m[1][1]])
    runs = placed.select("tree", "index", "doc_id", "leaf", "changed", "width").rdd.map(lambda r: ((r[0], r[1] // ARITY), (r[1] % ARITY, tuple(r[2:5]), r[5])))
    paths = descend(levels[1:], into)  # to the parents of the runs
    return spark.createDataFrame(runs.cogroup(paths, parts).flatMap(_proved), RESULT, verifySchema=False)
