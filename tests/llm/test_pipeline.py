import re

import numpy as np
from tests.llm import test_decontam, test_jaccard, test_packing, test_pii, test_quality
from tokenizers import Tokenizer

import corpus_pipeline
from tidebar.llm import packing
from tidebar.llm.common import table, written


def test_every_stage_against_brute_force(spark, sf):
    """Each stage on what its predecessor kept, on its own input."""
    docs = table(spark, sf, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "redact", "pack"]

    before = {r.doc_id: r for r in docs.collect()}
    docs = written(stages["quality"](spark, docs, sf), "t")
    after = {r.doc_id: r for r in docs.collect()}
    rows = [(r.lang, r.source, test_quality.brute(r.text)) for r in before.values()]
    want = [i for i, k in zip(before, test_quality.brute_kept(rows), strict=True) if k]
    assert docs.columns == columns and sorted(after) == sorted(want) and all(after[i] == before[i] for i in after)

    before = after
    docs = written(stages["near_duplicates"](spark, docs, sf), "t")
    after = {r.doc_id: r for r in docs.collect()}
    groups = test_jaccard.brute([(i, r.text) for i, r in before.items()])
    assert docs.columns == columns and sorted(after) == sorted(i for i, (_, c) in groups.items() if i == c)

    before = after
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    docs = written(stages["decontaminate"](spark, docs, sf), "t")
    after = {r.doc_id: r for r in docs.collect()}
    hit = test_decontam.brute([(i, r.text) for i, r in before.items()], items)
    assert docs.columns == columns and sorted(after) == sorted(before)
    assert all((after[i] == before[i]) == (not hit[i][4]) for i in after)
    for i in after:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), after[i].text)
        assert len(test_decontam.WORD.findall(lowered)) == hit[i][0] - hit[i][1]

    before = after
    docs = written(stages["redact"](spark, docs, sf), "t")
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and sorted(after) == sorted(before)
    for i, r in after.items():
        assert not test_pii.brute(r.text)
        assert test_pii.brute(before[i].text) or r.text == before[i].text
        assert r.n_chars == len(r.text) or r.n_chars == before[i].n_chars

    got = stages["pack"](spark, docs, sf).toPandas()
    exact = Tokenizer.from_file(packing.default_tokenizer()[0])
    test_packing.check_sequences(got, packing.CAPACITY)
    totals = got.groupby("doc_id").length.sum()
    assert sorted(totals.index) == sorted(after)
    for i, r in after.items():
        assert totals[i] == len(exact.encode(r.text, add_special_tokens=False).ids) + 1
    assert np.isin(got.length, range(1, packing.CAPACITY + 1)).all()


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
