import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidebar.llm import packing
from tidebar.llm.common import table
from tidebar.llm.queries import op5_best_fit_packing

SCHEMA = "doc_id long, text string, length int, bin string"


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(packing.default_tokenizer()[0])


def check_sequences(pdf, capacity):
    for _, g in pdf.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).tolist()
        assert g.offset.tolist() == [0, *ends[:-1]]
        assert ends[-1] <= capacity


def test_chunks_give_the_tokenizers_ids(exact):
    encoder = packing.ChunkEncoder(*packing.default_tokenizer())
    rng = random.Random(5)
    parts = ["a", "the", "Élan", " ", "  ", "\n", "\t", "x's", "12", ",", "!!", "日本", "\u00a0", "<|endoftext|>", "\\", "e\u0301", "ñ", "\U0001f600", "\r\n", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12)))
        got = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert got == exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_query_against_brute_force(spark, sf, exact):
    got = op5_best_fit_packing(spark, sf).toPandas()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert set(got.doc_id) == set(texts)
    for doc_id, g in got.sort_values("piece").groupby("doc_id"):
        ids = exact.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        assert g.piece.tolist() == list(range(len(g)))
        assert g.length.sum() == len(ids) and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert len(ids) <= 2048 and len(g) == 1 or all(g.length[1:] == 2048)
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    check_sequences(got, 2048)
    assert 0 <= got.sequence_id.nunique() - packing.lower_bound(got.length.to_numpy(), 2048) <= 1


def test_bound_holds_and_best_fit_is_near():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, c = int(rng.integers(1, 40)), int(rng.integers(4, 60))
        lengths = rng.integers(1, c + 1, n)
        bins, offsets, fill = packing.best_fit_decreasing(lengths, c)
        assert fill.max() <= c and fill.sum() == lengths.sum()
        bound = packing.lower_bound(lengths, c)
        assert -(-lengths.sum() // c) <= bound <= len(fill)


def test_exchange_between_groups_saves_sequences(spark):
    rng = random.Random(1)
    rows = [(i, 0, rng.randrange(20, 70)) for i in range(900)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    one = packing.pack_pieces(pieces, capacity=100, group_pieces=30, rounds=1).toPandas()
    three = packing.pack_pieces(pieces, capacity=100, group_pieces=30, rounds=3).toPandas()
    check_sequences(three, 100)
    assert sorted(three.doc_id) == sorted(one.doc_id) == list(range(900))
    assert three.sequence_id.nunique() <= one.sequence_id.nunique()


def test_edge_rows(spark):
    rows = [(1, None, 1, "x"), (2, "", 2, "x"), (3, "a b", 3, "x"), (3, "a b", 3, "x"), (None, "c", 4, None), (5, "word " * 5000, 5, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(docs, with_ids=True).toPandas()
    check_sequences(got, 2048)
    assert (got.doc_id == 3).sum() == 2 and got.doc_id.isna().sum() == 1
    assert got[got.doc_id == 1].length.tolist() == [1] and list(got[got.doc_id == 2].ids.iloc[0]) == [0]
    assert packing.pack(docs.limit(0)).count() == 0
