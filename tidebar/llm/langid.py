"""Language identification by bit-sliced Bloom filters of letter trigrams.

Every row of the filter is a word with one bit per language. A trigram's
languages are the AND of its k rows: one look-up tests all languages. A
language's filter holds the trigrams that make up more than min_share of the
trigrams in its training texts. A text's score for a language is its count of
trigram hits less the hits that false positives explain; ties go to the
language that sorts first.

Defined cases: a null text and a text without a letter get `und` and score 0;
a training row needs a text and a language; without training rows everything is
`und`; a text whose trigrams no language holds gets the language with most
training trigrams and score 0. Language, source and id are no inputs of a
prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import fold, map_batches, small_batches

#: A letter takes 6 bits: 0 is "no letter", a-z are 1 to 26, UTF-8 lead bytes 27 to 31, continuation bytes 32 to 63.
CODES = 1 << 18
HASHES = 3
ROWS_PER_GRAM = 12
MIN_SHARE = 2e-5
HELD_OUT_FOLD, FOLDS = 2, 4

_LETTER = re.compile(r"[^\W\d_]")


def _byte_classes() -> np.ndarray:
    classes = np.zeros(256, dtype=np.uint32)
    for i in range(26):
        classes[ord("a") + i] = classes[ord("A") + i] = i + 1
    for b in range(0x80, 0xC0):
        classes[b] = 32 + b % 32
    for b in range(0xC0, 0x100):
        classes[b] = 27 + b % 5
    return classes


BYTE_CLASS = _byte_classes()


def trigrams(text: str) -> np.ndarray:
    """Codes of the byte trigrams with a letter in the middle, words padded by "no letter"."""
    classes = np.zeros(2 + len(raw := text.lower().encode("utf-8", "replace")), dtype=np.uint32)
    classes[1:-1] = BYTE_CLASS[np.frombuffer(raw, dtype=np.uint8)]
    middle = classes[1:-1]
    return ((classes[:-2] << 12) | (middle << 6) | classes[2:])[middle > 0]


@dataclass
class BloomSlices:
    """rows: uint64 words, bit l of each for languages[l] (64 languages to a slice, more slices where needed)."""

    languages: list[str]
    rows: np.ndarray  # (slices, m)
    false_positive: np.ndarray  # by language
    fallback: str

    @staticmethod
    def positions(codes: np.ndarray, m: int) -> np.ndarray:
        h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b) % np.uint64(m)).astype(np.int64) for i in range(HASHES)])

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], totals: dict[str, int]) -> BloomSlices:
        languages = sorted(grams)
        m = max(64, ROWS_PER_GRAM * max((len(g) for g in grams.values()), default=1))
        rows = np.zeros((max(1, -(-len(languages) // 64)), m), dtype=np.uint64)
        for i, language in enumerate(languages):
            bit = np.uint64(1) << np.uint64(i % 64)
            rows[i // 64][np.unique(cls.positions(grams[language], m))] |= bit
        share = [np.count_nonzero(rows[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / m for i in range(len(languages))]
        fallback = max(languages, key=lambda x: (totals[x], x), default="und")
        return cls(languages, rows, np.asarray(share) ** HASHES, fallback)

    def lookup(self) -> np.ndarray:
        """The filter's answer for every code, (slices, CODES): the look-ups of all possible trigrams, done once."""
        at = self.positions(np.arange(CODES), self.rows.shape[1])
        found = self.rows[:, at[0]]
        for p in at[1:]:
            found &= self.rows[:, p]
        return found

    def hits(self, masks: np.ndarray) -> np.ndarray:
        """Popcounts by language of (slices, n) answers."""
        return np.asarray([np.count_nonzero(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.languages))], dtype=np.float64)

    def decide(self, text: str | None, answers: np.ndarray) -> tuple[str, float]:
        if text is None or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        codes = trigrams(text)
        if not len(codes):
            return self.fallback, 0.0
        n = len(codes)
        true = np.clip((self.hits(answers[:, codes]) - n * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive), 0, n)
        if true.max() <= 0:
            return self.fallback, 0.0
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / n)


def trigram_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, code, n over all texts; a task sends one row for each of its distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(CODES, dtype=np.int64)
                found = trigrams(text)
                if len(found) > 20_000:
                    counts[lang] += np.bincount(found, minlength=CODES)
                else:
                    codes, n = np.unique(found, return_counts=True)
                    counts[lang][codes] += n
        for lang, n in counts.items():
            codes = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(n[codes], pa.int64())], names=["lang", "code", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return small_batches(rows).mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE) -> BloomSlices:
    """Counts come from all given rows; at most CODES trigrams a language reach the driver."""
    total: dict[str, int] = {}
    grams: dict[str, list[tuple[int, int]]] = {}
    for lang, code, n in trigram_counts(docs, text_col=text_col, lang_col=lang_col).toLocalIterator():
        total[lang] = total.get(lang, 0) + n
        grams.setdefault(lang, []).append((code, n))
    kept = {lang: np.asarray([c for c, n in pairs if n >= min_share * total[lang]], dtype=np.int64) for lang, pairs in grams.items()}
    return BloomSlices.build(kept, total)


def predict(docs: DataFrame, model: BloomSlices, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score. The model is broadcast: at most ROWS_PER_GRAM * CODES words for 64 languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = shared.value
        answers = found.lookup()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            said = [found.decide(text, answers) for text in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return step

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents outside the held-out fold that have a language, then predicts all."""
    model = train(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"), "lang_pred", "score")
