"""Best-fit packing of tokenised documents with certified bin counts.

Documents are tokenised, closed by one end id and cut where longer than a
sequence. Pieces are dealt to groups of bounded size; each group is packed by
best-fit decreasing and certified by dual-feasible-function lower bounds. A
group whose count equals its bound is optimal and final. The others give up the
documents of their emptiest sequences, which meet in new groups and are packed
again, for a fixed number of rounds.

Defined cases: a null or empty text has only the end id (one piece of length
1); repeated rows are packed once each; an empty table gives an empty result;
columns other than the id and text columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import small_batches, written

CAPACITY = 2048
END_ID = 0
#: Pieces of one packing group (a task's memory), and rounds of exchange between groups.
GROUP_PIECES = 4096
ROUNDS = 3
#: Sequences that a group gives up for each one above its bound.
FREED_PER_GAP = 32
#: Space-separated chunks whose ids a worker remembers.
CACHE_CHUNKS = 300_000

_UNSAFE_SPACE = re.compile(r" (?:\s|\Z)")


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class ChunkEncoder(dict):
    """Text to little-endian 32-bit ids, remembering the ids of " chunk".

    The pre-tokeniser always starts a new token at a single space that stands
    before a non-space, so the ids of a text are those of its chunks in order.
    Texts with any other space are encoded whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_path)
        self.quick = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        # letters beyond these blocks may be classed differently by the two libraries' Unicode tables
        if self.quick and "<|" not in text and (text.isascii() or max(text) < "ɐ"):
            found = self.quick.encode_ordinary(text)
        else:
            found = self.exact.encode(text, add_special_tokens=False).ids
        return np.asarray(found, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = found = self.ids(" " + chunk)
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNSAFE_SPACE.search(text):
            return self.ids(text)
        if len(self) > CACHE_CHUNKS:
            self.clear()
        first, *rest = text.split(" ")
        return (self.ids(first) if first else b"") + b"".join(map(self.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_path: str, ranks_path: str | None) -> ChunkEncoder:
    """One per Python worker, so that its memory is warm for later tasks."""
    return ChunkEncoder(tokenizer_path, ranks_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def tokenised_pieces(docs: DataFrame, *, tokenizer_path: str, ranks_path: str | None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with_ids, ids array<int>."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, ranks_path)
        for batch in batches:
            docs_, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encoder.encode(text or "") + end
                for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * s : 4 * (s + n)]
                    docs_.append(doc_id)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [pa.array(docs_, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least bins that any packing needs, by two families of dual feasible functions.

    First: for each t up to half the capacity, items over capacity - t fill a
    bin alone, items below t count as nothing (Martello and Toth's L2). Second:
    for k, a length x counts x where (k+1)x/capacity is whole, else
    floor((k+1)x/capacity)/k (Fekete and Schepers' u^(k)).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    upto, mass = np.cumsum(count), np.cumsum(count * sizes)
    half = capacity // 2
    t = np.arange(half + 1)
    alone = upto[capacity] - upto[capacity - t]
    large = upto[capacity - t] - upto[half]
    large_mass = mass[capacity - t] - mass[half]
    small_mass = mass[half] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    over = np.maximum(0, small_mass - (large * capacity - large_mass))
    best = int(np.max(alone + large + -(-over // capacity)))
    for k in range(1, 41):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(whole, k * sizes, (scaled // capacity) * capacity)
        best = max(best, -(-int(np.dot(value, count)) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin; ties go to the earlier item and the fullest bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        free[room - n].append(b)
        mask |= 1 << (room - n)
    fill = np.zeros(used, dtype=np.int64)
    np.add.at(fill, bins, lengths)
    return bins, offsets, fill


def _packer(capacity: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        freed = np.zeros(len(fill), dtype=bool)
        if gap > 0 and not last:
            freed[np.argsort(fill, kind="stable")[: gap * FREED_PER_GAP]] = True
        return pdf.assign(bin=bins, offset=offsets, final=~freed[bins], gap=np.int64(gap))

    return pack


def pack(docs: DataFrame, *, tokenizer_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence_id and offset (and their ids, with_ids)."""
    if tokenizer_path is None:
        tokenizer_path, ranks_path = default_tokenizer()
    pieces = written(tokenised_pieces(docs, tokenizer_path=tokenizer_path, ranks_path=ranks_path, capacity=capacity, end_id=end_id, with_ids=with_ids, id_col=id_col, text_col=text_col), "pieces")
    return pack_pieces(pieces, capacity=capacity, group_pieces=group_pieces, rounds=rounds)


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Packs a written table of pieces with columns doc_id, piece and length; other columns are carried along."""
    columns = pieces.columns
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done = pieces.where(F.col("length") < capacity), [full]
    left = rest.count()
    for r in range(rounds):
        if not left:
            break
        groups = -(-left // group_pieces)
        last = r == rounds - 1 or groups == 1
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(groups)))
        schema = dealt.schema.simpleString()[7:-1] + ",bin:bigint,offset:bigint,final:boolean,gap:bigint"
        packed = written(dealt.groupBy("grp").applyInPandas(_packer(capacity, last), schema), "packed")
        number = F.lit(r << 58) + F.shiftleft(F.col("grp"), 26) + F.col("bin")
        done.append(packed.where("final").select(*columns, number.alias("sequence_id"), "offset"))
        if last:
            break
        rest = packed.where("not final").select(*columns)
        left = rest.count()
    return functools.reduce(DataFrame.unionByName, done)
