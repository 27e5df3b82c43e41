r"""N-gram Jaccard join by parity sketches: exact links at 0.75, and their components.

A document's set is its distinct 5-word shingles as 64-bit hashes. A linking
pair of sizes a <= b differs in at most (a+b)/7 shingles. XOR-hashing a set to S
segments (a very wide parity sketch, each segment kept as the XOR of its
shingles' hashes) changes at most one segment for each differing shingle, so all
but D of the segments are equal, and the pigeonhole finds the pair by one equal
segment. Segments are ordered by content (those of more shingles first); the
D + 1 first non-empty ones of each document share one at least, and `slack` more
make up for keys too frequent to pair: a linking pair shares 1 + slack keys, so
that one which meets under fewer, its frequent keys counted in, is dropped.

Size bands: the number of segments is fixed by the band of the smaller document;
a document joins its own band and those lower ones whose documents it can link
with. Candidates are first held against a bit sketch, whose Hamming distance is
a lower bound of the symmetric difference, then verified on the sets.

Copies: equal sets are one class, named by its least id; classes, not documents,
are joined. Keys carry a class's code (48 bits of its print, and its size), by
which a bucket tells copies; classes that share a code are candidates of their
own. Keys cross the network once, and no table of them is written. A key of more
than GROUP classes isn't paired: its classes are held against a few hubs. A class
with more such keys than its slack may have lost links; those are found exactly
in a second join of these classes alone, on their rarest shingles, between
different components.

Defined cases: null and empty texts and texts of white space have no shingles
and are linked with nothing; below five words the whole sequence is one
shingle; a null id is its own component (null) and linked with nothing; an id
that repeats with another text is one document, held by the larger of its sets;
repeated rows are copies; an empty table gives an empty result. Other columns
are not read.

Set sizes and overlaps are of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.common import small_batches, written
from tidebar.llm.components import components

SHINGLE = 5
#: Documents for each bucket of segment keys; keys a task holds before it sends them on.
BUCKET_DOCS = 8192
FLUSH_KEYS = 1 << 19
#: Most classes of a key that are paired with each other.
GROUP = 32
HUBS = 2
#: Documents of one shingle that are compared in one block of the second join; more of them are dealt to pairs of blocks.
BLOCK_DOCS = 1024
CACHE_WORDS = 250_000

_U = np.uint64
_STEPS = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The set as sorted hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=_U, count=len(words))
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, dtype=_U)
    for i in range(size):
        out += h[i : i + len(out)] * _STEPS[i]
    return np.unique(mix(out))


def _band_starts() -> np.ndarray:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(2 * starts[-1])
    return np.asarray(starts)


BANDS = _band_starts()


def band(n: int) -> int:
    return int(n).bit_length() - 1


def most_different(a: int, b: int) -> int:
    """Most differing shingles of a linking pair of these sizes."""
    return (a + b) // 7


def segments(k: int) -> int:
    """How many for the band [2^k, 2^(k+1))."""
    low = int(BANDS[k])
    return 2 * low + 2 * int(low**0.5) + 1


def slack(k: int) -> int:
    return 1 + int(BANDS[k]) // 8


def configurations(n: int) -> list[tuple[int, int]]:
    """(band of the smaller document, most different shingles) that a set of n joins."""
    k = band(n)
    out = [(k, most_different(n, 4 * n // 3))]
    top = int(BANDS[k]) - 1  # largest of the band below
    if k and 3 * n <= 4 * top:
        out.append((k - 1, most_different(n, top)))
    return out


def segment_keys(s: np.ndarray, k: int, d: int) -> tuple[np.ndarray, int]:
    """The first keys of a set in band k's configuration, and how many of them may be too frequent without harm (-1: none of its pairs is certain)."""
    count = segments(k)
    seed = _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    place = (((s ^ seed) * _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.int64) * count >> 32
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    values = np.bitwise_xor.reduceat(s[order], starts)
    sizes = np.diff(np.append(starts, len(s)))
    keys = mix(values ^ mix(place[starts].astype(_U) * _U(64) + _U(k)))
    rank = (_U(255) - np.minimum(sizes, 255).astype(_U)) << _U(56) | keys >> _U(8)
    wanted = d + 1 + slack(k)
    if len(keys) > wanted:
        keys = keys[np.argpartition(rank, wanted - 1)[:wanted]]
    spare = min(slack(k), len(values) - d - 1)
    if spare < 0:  # too few segments: such sets also meet under one key of the band
        keys = np.append(keys, mix(np.asarray([0xFFFFFFFF00 + k], dtype=_U)))
    return keys, max(-1, spare)


def bit_sketch(s: np.ndarray) -> bytes:
    """One parity bit a shingle, as many bits as shingles, a power of two."""
    m = max(64, 1 << max(0, len(s) - 1).bit_length())
    bits = np.bincount((s & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two bit sketches; the longer one is folded to the shorter one's length."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


#: One row for each flush and bucket: codes of its classes, keys and their classes; and one a flush, in a bucket below 0, for its documents.
_KEYS = "bucket int, codes binary, keys binary, owner binary, sketches array<binary>"
_NODE = np.dtype([("doc", "<i8"), ("n", "<i8"), ("f1", "<u8"), ("f2", "<u8"), ("code", "<u8"), ("spare", "<i4"), ("below", "<i4")])
#: The bit of a code that tells its keys of the band below from those of its own.
BELOW = 1 << 15
#: below of a class that doesn't join the band below.
NOT_BELOW = -2


def class_code(n: int, f1: int) -> int:
    """48 bits of a class's print, BELOW unset, and its size to 10 bits' accuracy (rounded down)."""
    e = max(0, n.bit_length() - 10)
    return int(mix(np.asarray([f1 ^ n * 0x9E3779B97F4A7C15 % (1 << 64)], dtype=_U))[0]) >> 16 << 16 | e << 10 | n >> e


def code_sizes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest sizes of codes."""
    e = ((codes >> _U(10)) & _U(31)).astype(np.int64)
    low = (codes & _U(1023)).astype(np.int64) << e
    return low, low + (1 << e) - 1


def _key_table(docs: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        nodes: list[tuple] = []
        sketches: list[bytes] = []
        codes: list[int] = []
        held: list[np.ndarray] = []
        seen: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(-1 - nodes[0][0] % (1 << bits), b"", np.asarray(nodes, dtype=_NODE).tobytes(), b"", list(sketches))]
            keys = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
            table = np.asarray(codes, dtype="<u8")
            bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            rest = ((keys >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype("<u4")
            for b in range(1 << bits):
                part = order[ends[b] : ends[b + 1]]
                if len(part):
                    mine, own = np.unique(owner[part], return_inverse=True)
                    small = "<u2" if len(mine) < 1 << 16 else "<u4"
                    rows.append((b, table[mine].tobytes(), rest[part].tobytes(), own.astype(small).tobytes(), None))
            columns = [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)], pa.array([r[4] for r in rows], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "codes", "keys", "owner", "sketches"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text, hashes)
                if not len(s) or doc is None:
                    continue
                print_ = (len(s), int(np.bitwise_xor.reduce(s)), int(mix(s + _U(1)).sum(dtype=_U)))
                if print_ in seen:  # a copy of what this flush holds
                    nodes.append((doc, *print_, *seen[print_]))
                    sketches.append(b"")
                    continue
                code, spares = class_code(len(s), print_[1]), []
                for at, (k, d) in enumerate(configurations(len(s))):
                    keys, spare = segment_keys(s, k, d)
                    codes.append(code | at * BELOW)
                    held.append(keys)
                    size += len(keys)
                    spares.append(spare)
                seen[print_] = code, *(spares + [NOT_BELOW])[:2]
                nodes.append((doc, *print_, *seen[print_]))
                sketches.append(bit_sketch(s))
            if size >= FLUSH_KEYS:
                yield from flush()
                for x in (nodes, sketches, codes, held, seen):
                    x.clear()
                size = 0
        if nodes:
            yield from flush()

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, _KEYS)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= 75 * np.maximum(a, b)


def bucket_candidates(tables: list[tuple[bytes, bytes, bytes]]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of one bucket's rows: pairs of codes and how many keys each meets under; codes with keys of too many classes, and how many; and codes with the codes that stand for such keys."""
    keys = np.concatenate([np.frombuffer(k, dtype="<u4") for _, k, _ in tables])
    # most keys stand alone: only the others are looked at
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    del same
    keys = keys[order]
    code = np.concatenate([np.frombuffer(c, dtype="<u8")[np.frombuffer(o, dtype="<u2" if len(o) == len(k) // 2 else "<u4")] for c, k, o in tables])[order]
    none = (code[:0], code[:0], np.zeros(0, dtype=np.int64)), (code[:0], np.zeros(0, dtype=np.int32)), (code[:0], code[:0])
    if not len(keys):
        return none
    codes, owner = np.unique(code, return_inverse=True)
    owner = owner.reshape(-1).astype(np.int32)
    del order, code
    # of equal keys of a class one stays
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
    keys, owner = keys[first], owner[first]
    del order, first
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    size_of = np.repeat(sizes, sizes)
    low, high = code_sizes(codes)
    below = codes & _U(BELOW) != 0
    found: list[np.ndarray] = []
    times: list[np.ndarray] = []

    def pair(x: np.ndarray, y: np.ndarray) -> None:
        """Adds the pairs that can fit; two that both stand in the band below meet in their own."""
        fit = (x != y) & ~(below[x] & below[y]) & (100 * high[x] >= 75 * low[y]) & (100 * high[y] >= 75 * low[x])
        x, y = x[fit].astype(_U), y[fit].astype(_U)
        each, n = np.unique(np.minimum(x, y) << _U(32) | np.maximum(x, y), return_counts=True)
        found.append(each)
        times.append(n)

    some = (size_of > 1) & (size_of <= GROUP)
    k, o = keys[some], owner[some]
    for step in range(1, min(GROUP, len(k))):
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        pair(o[at], o[at + step])
    hot = size_of > GROUP
    k, o = keys[hot], owner[hot]
    del some, hot, size_of, keys, owner
    crowded, ties = none[1:]
    if len(k):
        often = np.bincount(o, minlength=len(codes)).astype(np.int32)
        mine = np.flatnonzero(often)
        crowded = codes[mine], often[mine]
        # hubs: the smallest sets, and those with most such keys, which stand in the middle of their group
        for rank in (low, -often):
            by = np.lexsort((o, rank[o], k))
            x = o[by]
            begin = np.flatnonzero(np.concatenate([[True], k[by][1:] != k[by][:-1]]))
            begin = np.repeat(begin, np.diff(np.append(begin, len(x))))
            place = np.arange(len(x)) - begin
            for h in range(HUBS):
                far = np.flatnonzero(place > h)
                pair(x[begin[far] + h], x[far])
        # the last order's first class stands for its key: who meets whom under such keys, each once
        each = np.unique(x[begin].astype(_U) << _U(32) | x.astype(_U))
        ties = codes[(each >> _U(32)).astype(np.int64)], codes[(each & _U(0xFFFFFFFF)).astype(np.int64)]
        ties = ties[0][ties[0] != ties[1]], ties[1][ties[0] != ties[1]]
    if not found:
        return none[0], crowded, ties
    each, at = np.unique(np.concatenate(found), return_inverse=True)
    met = np.bincount(at.reshape(-1), weights=np.concatenate(times), minlength=len(each)).astype(np.int64)
    return (codes[(each >> _U(32)).astype(np.int64)], codes[(each & _U(0xFFFFFFFF)).astype(np.int64)], met), crowded, ties


_SAID = "a long, b long, met long, hot int, doc_id long, n long, f1 long, f2 long, code long, spare int, below int, sketch binary"


def _candidates(table: DataFrame) -> DataFrame:
    """a, b, met: codes of a candidate pair and the keys it meets under; a and hot: a code and how many of its keys have too many classes; a and b alone: codes that meet under such a key, b standing for it; or doc_id and the rest: a document and its class."""
    names = [c.split()[0] for c in _SAID.split(", ")]
    types = dict(zip(names, [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()], strict=True))

    def rows(count: int, **columns: pa.Array) -> pa.Table:
        return pa.table({c: columns.get(c, pa.nulls(count, t)) for c, t in types.items()})

    def run(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            r = np.concatenate([np.frombuffer(x, dtype=_NODE) for x in group.column("keys").to_pylist()])
            sketches = pa.array([x for s in group.column("sketches").to_pylist() for x in s], pa.binary())
            numbers = {c: pa.array(r[f].view("<i8") if r[f].dtype.kind == "u" else r[f]) for c, f in (("doc_id", "doc"), *[(x, x) for x in ("n", "f1", "f2", "code", "spare", "below")])}
            return rows(len(r), **numbers, sketch=sketches)
        parts = list(zip(*(group.column(c).to_pylist() for c in ("codes", "keys", "owner")), strict=True))
        del group
        (a, b, met), (crowded, hot), (hubs, members) = bucket_candidates(parts)
        signed = lambda x: pa.array(x.view("<i8"))
        return pa.concat_tables([rows(len(a), a=signed(a), b=signed(b), met=pa.array(met)), rows(len(hot), a=signed(crowded), hot=pa.array(hot)), rows(len(hubs), a=signed(members), b=signed(hubs))])

    return table.groupBy("bucket").applyInArrow(run, _SAID)


def _classes(nodes: DataFrame) -> DataFrame:
    """n, f1, f2, rep (the least id), code, spare, below, sketch. An id that repeats counts with its largest set."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("f1"), F.desc("f2"), F.desc(F.length("sketch")))
    once = nodes.withColumn("place", F.row_number().over(w)).where("place = 1")
    return once.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("code").alias("code"), F.max("spare").alias("spare"), F.max("below").alias("below"), F.max("sketch").alias("sketch"))


def _needs(classes: DataFrame, said: DataFrame) -> DataFrame:
    """code, spare, scant (it has fewer spare keys than its band's slack), hot (keys with too many classes): codes as the keys carry them, BELOW or not."""
    k = F.length(F.bin("n")) - 1
    scant = lambda spare, k: (F.col(spare) < F.lit(1) + F.expr(f"shiftleft(1L, cast({k} as int)) div 8")).alias("scant")
    known = classes.select("code", "spare", "below", k.alias("k"))
    each = known.select("code", "spare", scant("spare", "k")).union(known.where(F.col("below") > NOT_BELOW).select(F.col("code").bitwiseOR(F.lit(BELOW)), "below", scant("below", "k - 1")))
    hot = said.where("hot is not null").groupBy(F.col("a").alias("code")).agg(F.sum("hot").alias("hot"))
    return each.groupBy("code").agg(F.min("spare").alias("spare"), F.bool_or("scant").alias("scant")).join(hot, "code", "left").select("code", "spare", "scant", F.coalesce("hot", F.lit(0)).alias("hot"))


def _needy(needs: DataFrame, ties: DataFrame) -> DataFrame:
    """code of the classes that may have lost links: those with more frequent keys than spare ones, and all that meet one of these with scant spare keys under a frequent key, as the lesser spare of a pair counts."""
    short = needs.where("hot > spare and hot > 0")
    scant = short.where("scant").select("code")
    hubs = ties.join(scant, F.col("a") == F.col("code"), "left_semi").select("b").union(scant).distinct()
    met = ties.join(hubs, "b", "left_semi").select("a")
    return short.select("code").union(met).union(hubs).select(_own("code")).distinct()


def _own(code: str) -> Column:
    """The class's code, whichever band its keys were of."""
    return F.col(code).bitwiseAND(F.lit(~BELOW)).alias(code)


def _enough(said: DataFrame, needs: DataFrame) -> DataFrame:
    """Pairs of codes that meet under as many keys as a link asks for."""
    side = lambda x: needs.select(F.col("code").alias(x), F.col("spare").alias(f"spare_{x}"), F.col("hot").alias(f"hot_{x}"))
    pairs = said.where("met is not null").groupBy("a", "b").agg(F.sum("met").alias("met"))
    asked = 1 + F.least("spare_a", "spare_b") - F.least("hot_a", "hot_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("met") >= asked).select("a", "b")


def _near_by_bits(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Documents a, b of the pairs of codes whose bit sketches allow a link."""
    twins = classes.groupBy("code").agg(F.count("*").alias("classes")).where("classes > 1").select(F.col("code").alias("a"), F.col("code").alias("b"))
    s = lambda x: classes.select(F.col("code").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.select(_own("a"), _own("b")).union(twins)
    joined = both.join(s("a"), "a").join(s("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(i)) for i in (2, 3))
            ok = [_close(x, y, int(m), int(n)) for x, y, m, n in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


def _close(x: bytes, y: bytes, m: int, n: int) -> bool:
    """Whether the bit sketches of sets of m and n shingles allow a link; an unknown sketch does."""
    return not x or not y or hamming(x, y) <= most_different(m, n)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the ids' hashes: 16 an id, from 2^20 to 2^27 bits in all (16 MB), built on the executors in pieces of 4 KB."""
    m = 1 << min(27, max(20, (16 * ids.count()).bit_length()))
    at = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(m)).alias("at"))
    pieces = at.groupBy(F.expr("at div 32768").alias("piece")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("bits"))
    out = np.zeros(m // 8, dtype=np.uint8)
    for r in pieces.toLocalIterator():
        out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, hashes (binary) of the documents in ids. Texts stay in their tasks; a bitmap tells most of the others apart."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), bits.value
        m = len(known) * 8
        for batch in batches:
            at = batch.column(2).to_numpy() % m
            batch = batch.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            found = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
            f1 = np.asarray([np.bitwise_xor.reduce(s) for s in found], dtype=_U).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f1), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "f1", "hashes"])

    made = small_batches(rows.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))).mapInArrow(run, "doc_id long, f1 long, hashes binary")
    return made.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("hashes", F.struct(F.length("hashes"), "f1")).alias("hashes"))


def linked(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, dtype=_U), np.frombuffer(b, dtype=_U)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both) and both > 0


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link, as edges u, v."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(_sets(docs, ids), "sets")
    s = lambda x: sets.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"h{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(s("a"), "a").join(s("b"), "b").select("a", "b", "ha", "hb").mapInArrow(run, "u long, v long")


def _open(needy: DataFrame, ties: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, component of the needy documents whose components meet another under a frequent key. Who meets nobody but its own component links nothing new."""
    named = classes.select("code", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("code", "rep", F.coalesce("component", "rep").alias("component"))
    side = lambda x: named.select(F.col("code").alias(x), F.col("component").alias(f"c{x}"))
    met = ties.select(_own("a"), _own("b")).distinct().join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("ca", "cb").distinct()
    either = met.select(F.col("ca").alias("component")).union(met.select("cb")).distinct()
    return needy.join(named, "code").select(F.col("rep").alias("doc_id"), "component").distinct().join(either, "component", "left_semi").select("doc_id", "component")


def _second_pairs(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs of documents (doc_id, component) of different components by a shared shingle among the n/4 + 1 rarest of each: all that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, component, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = np.frombuffer(data, dtype="<i8")
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.full(n, component)), pa.array(np.full(n, n)), pa.array(h)], names=["doc_id", "component", "n", "shingle"])

    sets = _sets(docs, ids.select("doc_id")).join(ids, "doc_id").select("doc_id", "component", "hashes")
    tall = written(sets.mapInArrow(run, "doc_id long, component long, n long, shingle long"), "needy_shingles")
    # only shingles of two components matter; a document's partners share at most its n_shared of them
    shared = tall.groupBy("shingle").agg(F.count("*").alias("docs"), F.min("n").alias("least_n"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2")
    mine = tall.join(shared.select("shingle", "docs", "least_n"), "shingle")
    w = Window.partitionBy("doc_id")
    mine = mine.withColumn("n_shared", F.count("*").over(w)).where("4 * n_shared >= 3 * n").withColumn("rank", F.row_number().over(w.orderBy("docs", "shingle")))
    # a + b <= 7/3 of the overlap; the smallest document of a shingle is the best partner there
    first = mine.where("rank <= n div 4 + 1 - (n - n_shared) and 3 * (n + least_n) <= 7 * n_shared")
    first = first.withColumn("blocks", (F.col("docs") / BLOCK_DOCS).cast("int") + 1)
    first = first.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = first.select("shingle", "doc_id", "component", "n", "n_shared", "block", other.alias("other"))
    dealt = dealt.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("other")
    prefix = first.groupBy("doc_id").agg(F.array_sort(F.collect_list("shingle")).alias("prefix"))  # a quarter of a document's shingles at most
    rows = dealt.join(classes.select(F.col("rep").alias("doc_id"), "sketch").join(prefix, "doc_id"), "doc_id").select("shingle", "lo", "hi", "block", "doc_id", "component", "n", "n_shared", "sketch", "prefix")
    key = ["shingle", "lo", "hi"]
    return rows.repartition(*key).sortWithinPartitions(*key, "doc_id").mapInArrow(_pairs_of_groups, "a long, b long").distinct()


def _pairs_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and blocks: the pairs of two components that can link by sizes, shared shingles and bit sketches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 20_000:
            t = pa.Table.from_batches(held).combine_chunks()
            group = _group_numbers(t)
            whole = int(np.searchsorted(group, group[-1]))
            held = t.slice(whole).to_batches()
            if whole:
                yield _compared(t.slice(0, whole), group[:whole])
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield _compared(t, _group_numbers(t))


def _group_numbers(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    for c in ("shingle", "lo", "hi"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _compared(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
    doc, component, n, shared, block = (t.column(c).to_numpy() for c in ("doc_id", "component", "n", "n_shared", "block"))
    across = t.column("lo").to_numpy() != t.column("hi").to_numpy()
    docs, row, number = np.unique(doc, return_index=True, return_inverse=True)
    found: list[np.ndarray] = []
    for step in range(1, len(group)):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        j = i + step
        ok = (component[i] != component[j]) & ~(across[i] & (block[i] == block[j])) & _fits(n[i], n[j]) & (3 * (n[i] + n[j]) <= 7 * np.minimum(shared[i], shared[j]))
        x, y = number[i[ok]].astype(_U), number[j[ok]].astype(_U)
        found.append(np.unique(np.minimum(x, y) << _U(32) | np.maximum(x, y)))
    codes = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=_U)
    a, b = (codes >> _U(32)).astype(np.int64), (codes & _U(0xFFFFFFFF)).astype(np.int64)
    sketch = t.column("sketch").to_pylist()
    here, prefix = set(t.column("shingle").to_numpy().tolist()), t.column("prefix").to_pylist()

    def keeps(x: int, y: int) -> bool:
        """A pair meets under many shingles; it is kept under the least one."""
        if not _close(sketch[x], sketch[y], int(n[x]), int(n[y])):
            return False
        return min(set(prefix[x]) & set(prefix[y])) in here

    ok = np.asarray([keeps(row[x], row[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
    return pa.RecordBatch.from_arrays([pa.array(docs[a[ok]]), pa.array(docs[b[ok]])], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document row."""
    bits = max(0, -(-docs.count() // BUCKET_DOCS) - 1).bit_length()
    said = written(_candidates(_key_table(docs, bits)), "candidates")
    nodes = said.where("n is not null").select("doc_id", "n", "f1", "f2", "code", "spare", "below", "sketch")
    classes = written(_classes(nodes), "classes")
    needs = written(_needs(classes, said), "needs")
    near = written(_near_by_bits(_enough(said, needs), classes), "near")
    edges = written(_verified(docs, near), "links")
    ties = said.where("b is not null and met is null").select("a", "b")
    ids = written(_open(_needy(needs, ties), ties, classes, components(edges)), "needy")
    if not ids.isEmpty():
        more = written(_second_pairs(docs, classes, ids), "near")
        edges = edges.union(_verified(docs, more))
    named = classes.select("n", "f1", "f2", "rep").join(components(edges).select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    largest = F.max(F.struct("n", "f1", "f2")).over(Window.partitionBy("doc_id")).alias("set")
    known = nodes.select("doc_id", largest).select("doc_id", "set.*").join(named, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    empty = rest.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False)))
    return known.union(_unlinked(empty))


def _unlinked(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n = [len(shingles(t, hashes)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(0)], names=["doc_id", "n_shingles", "component_id"])

    return small_batches(rows).mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which each is the least id of its component. Null ids stay.

    Rows that repeat both id and text are copies: the first by all columns stays. Where an id repeats with other
    texts, each of its texts is a document of its own, named by a hash, so that no text goes but for a near copy.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null")
    if again.isEmpty():
        lead = near_duplicates(docs).where("doc_id = component_id").select("doc_id")
        kept = docs.join(lead, "doc_id", "left_semi").select(docs.columns)
    else:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        name = F.when(F.col("texts").isNull(), F.col("row.doc_id")).otherwise(F.xxhash64("row.doc_id", "row.text"))
        texts = docs.groupBy("doc_id").agg((F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("texts")).where("texts")
        rows = docs.where("doc_id is not null").select("doc_id", row).join(texts, "doc_id", "left")
        rows = written(rows.select(name.cast("long").alias("name"), "row"), "named")
        lead = near_duplicates(rows.select(F.col("name").alias("doc_id"), "row.text")).where("doc_id = component_id").select(F.col("doc_id").alias("name")).distinct()
        first = F.row_number().over(Window.partitionBy("name").orderBy(F.to_json("row")))
        kept = rows.join(lead, "name", "left_semi").withColumn("place", first).where("place = 1").select("row.*")
    return kept.unionByName(docs.where("doc_id is null")) if docs.schema["doc_id"].nullable else kept
