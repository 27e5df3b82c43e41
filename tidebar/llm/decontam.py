r"""Benchmark decontamination by an FM-index over each training shard.

A task cuts its documents into shards of bounded size. In a shard, words are
benchmark words' numbers; every run of other words becomes one separator, as no
occurrence can cross it, and runs shorter than the shortest window go too. The
shard's index is a Burrows-Wheeler transform in a wavelet tree with rank
tables, plus suffix positions sampled every SAMPLE_EVERY words. All windows of
the test items are searched backwards together; hits are located by walking to
a sampled position, and the windows of a document are merged to removal spans.

The items come in blocks of at most BLOCK_WORDS words; each block is broadcast
(its size is bounded by that), and the blocks' results are merged.

Defined cases: null texts have no words; an item without words matches nothing;
items with equal texts all count; an item with a null id is searched and
removed like the others but is in no item_ids; repeated document rows are judged row by row;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidebar.llm.common import small_batches

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE_EVERY = 8
BLOCK_WORDS = 1 << 20

#: ASCII bytes that stand between words, and A-Z to a-z; all other bytes stay.
_WORDS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in bytes(range(128)).lower()) + bytes(range(128, 256))
_WORD_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class WaveletTree:
    """Ranks of symbols in a sequence: one bit plane per symbol bit, most significant first, each with counts of zeros."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.before = bits, [], []
        now = symbols
        for level in reversed(range(bits)):
            bit = (now >> level) & 1
            zeros = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(1 - bit, out=zeros[1:])
            self.before.append(zeros)
            self.zeros.append(int(zeros[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        begin, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            zb, za = self.before[k][begin], self.before[k][at]
            begin = np.where(one, self.zeros[k] + begin - zb, zb)
            at = np.where(one, self.zeros[k] + at - za, za)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            zero = self.before[k][at + 1] - self.before[k][at] == 1
            za = self.before[k][at]
            at = np.where(zero, za, self.zeros[k] + at - za)
            out = (out << 1) | np.where(zero, 0, 1)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; symbols end in a unique least one."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int, sample_every: int = SAMPLE_EVERY):
        """symbols: from 1 to alphabet; 0 is the end mark, which this adds."""
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]  # before position 0 stands the end mark
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.tree = WaveletTree(bwt, max(1, int(alphabet).bit_length()))
        self.sampled = order % sample_every == 0
        self.marks = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows, padded at the end), all stepped backwards together."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: steps back until a sampled suffix."""
        found, steps, at = np.zeros(len(at), dtype=np.int64), 0, at.copy()
        live = np.arange(len(at))
        while len(live):
            hit = self.sampled[at[live]]
            done = live[hit]
            found[done] = self.samples[self.marks[at[done]]] + steps
            live = live[~hit]
            symbol = self.tree.access(at[live])
            at[live] = self.first[symbol] + self.tree.rank(symbol, at[live])
            steps += 1
        return found


@dataclass
class Block:
    """Items' windows: distinct phrases of word numbers, and which items have each."""

    vocabulary: dict[bytes, int]  # from 2; 1 is the separator
    phrases: np.ndarray
    lengths: np.ndarray
    owners: list[tuple[str, ...]]  # item ids by phrase

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], window: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, said in items:
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in said]
            for i in range(max(1, len(numbers) - window + 1)) if numbers else ():
                owners.setdefault(tuple(numbers[i : i + window]), set()).update(() if item is None else (item,))
        phrases = np.zeros((len(owners), window), dtype=np.int64)
        lengths = np.zeros(len(owners), dtype=np.int64)
        for k, p in enumerate(owners):
            phrases[k, : len(p)] = p
            lengths[k] = len(p)
        return cls(vocabulary, phrases, lengths, [tuple(sorted(x)) for x in owners.values()])


def item_blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark's items, streamed to the driver and cut into blocks of bounded size."""
    held, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        said = words(text)
        if not said:
            continue
        if held and size + len(said) > block_words:
            yield Block.of(held, window)
            held, size = [], 0
        held.append((None if item is None else str(item), said))
        size += len(said)
    if held:
        yield Block.of(held, window)


def shard_hits(texts: list[str | None], block: Block, sample_every: int = SAMPLE_EVERY) -> tuple[list[int], list[dict[int, list[int]]]]:
    """Word counts, and for each text {phrase: word positions where it begins}."""
    counts, kept, place, document, at = [], [], [], [], 0
    shortest = int(block.lengths.min()) if len(block.lengths) else 1
    number, none = block.vocabulary.get, 1
    for d, text in enumerate(texts):
        said = words(text)
        counts.append(len(said))
        if len(said) < shortest:
            continue
        ids = np.fromiter(map(number, said, [none] * len(said)), dtype=np.int64, count=len(said))
        known = np.flatnonzero(np.diff(np.concatenate([[False], ids != none, [False]]).astype(np.int8)))
        for begin, end in known.reshape(-1, 2).tolist():  # runs of benchmark words
            if end - begin >= shortest:
                kept += [ids[begin:end], np.ones(1, dtype=np.int64)]
                place.append((at, begin))
                document.append(d)
                at += end - begin + 1
    found: list[dict[int, list[int]]] = [{} for _ in texts]
    if not kept or not len(block.lengths):
        return counts, found
    index = FMIndex(np.concatenate(kept), len(block.vocabulary) + 1, sample_every)
    low, high = index.search(block.phrases, block.lengths)
    n = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(n)), n)
    position = index.locate(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    starts = np.asarray([p[0] for p in place], dtype=np.int64)
    run = np.searchsorted(starts, position, side="right") - 1
    for p, pos, r in zip(phrase.tolist(), position.tolist(), run.tolist(), strict=True):
        found[document[r]].setdefault(p, []).append(pos - place[r][0] + place[r][1])
    return counts, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, judge: Callable, schema: str) -> DataFrame:
    """judge(rows, counts, [(spans, items)]) makes the output batch of a shard."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in item_blocks(benchmark, window)]
    text_at = docs.columns.index("text")

    def shard(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        texts = rows.column(text_at).to_pylist()
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        counts = None
        for b in blocks:
            counts, found = shard_hits(texts, b.value)
            for d, hits in enumerate(found):
                for phrase, at in hits.items():
                    items[d].update(b.value.owners[phrase])
                    spans[d] += [(i, i + int(b.value.lengths[phrase])) for i in at]
        if counts is None:
            counts = [len(words(t)) for t in texts]
        return judge(rows, texts, counts, [merged(x) for x in spans], items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes // 6
            if size >= shard_words:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    return small_batches(docs).mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, removal spans in words, item_ids: one row per document row."""
    schema = "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def judge(rows, texts, counts, spans, items):
        columns = [rows.column(0).cast(pa.int64()).combine_chunks(), pa.array(counts, pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_words", "spans", "item_ids"]).to_batches()

    return _scan(docs.select("doc_id", "text"), benchmark, window, shard_words, judge, schema)


def removal(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of spans and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in _WORD_SPAN.finditer(text)]
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : at[s][0]])
        done = at[e - 1][1]
    return "".join([*out, text[done:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents, all columns, with the removal spans cut out of their texts; n_chars, where there is one, is that of the new text."""
    names = docs.columns
    text_at = names.index("text")

    def judge(rows, texts, counts, spans, items):
        new = [removal(t, x) if x else t for t, x in zip(texts, spans, strict=True)]
        rows = rows.set_column(text_at, rows.schema.field(text_at), pa.array(new, rows.schema.field(text_at).type))
        if "n_chars" in names:
            k = names.index("n_chars")
            old = rows.column(k).to_pylist()
            chars = [len(t) if x else o for t, x, o in zip(new, spans, old, strict=True)]
            rows = rows.set_column(k, rows.schema.field(k), pa.array(chars, rows.schema.field(k).type))
        return rows.to_batches()

    return _scan(docs, benchmark, window, shard_words, judge, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
