import hashlib
import random
import re

import numpy as np

from tidebar.llm import decontam
from tidebar.llm.common import table
from tidebar.llm.queries import op7_benchmark_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=10):
    phrases = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(p) for p in phrases}
    out = {}
    for doc_id, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if who := phrases.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= who
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = brute(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op7_benchmark_decontamination(spark, sf).collect()}
    assert got == want
    assert any(x[4] for x in got.values())


def test_index_counts_and_locates_every_occurrence():
    rng = np.random.default_rng(2)
    for alphabet in (2, 3, 9):
        text = rng.integers(1, alphabet + 1, 400)
        index = decontam.FMIndex(text, alphabet, 5)
        phrases = np.zeros((50, 4), dtype=np.int64)
        lengths = rng.integers(1, 5, 50)
        for k, n in enumerate(lengths):
            phrases[k, :n] = rng.integers(1, alphabet + 1, n)
        low, high = index.search(phrases, lengths)
        for k, n in enumerate(lengths):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrases[k, :n]).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_random_texts_short_items_ties_and_edges(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("ab cd ef Gh".split()) for _ in range(n))
    docs = [(i, say(rng.randrange(0, 60)), "z") for i in range(60)] + [(60, None, "z"), (61, "", None), (3, "AB-cd", "dup"), (62, "x " * 3000 + say(30), "long")]
    items = [(1, say(12)), (2, "gh gh gh"), (10, "Gh, gh gh"), (3, None), (4, "..."), (5, say(10)), (6, "日本 ab")]
    d = spark.createDataFrame(docs, "doc_id long, text string, window string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(i, t) for i, t, _ in docs if i != 3], items)
    got = decontam.scan(d, b, shard_words=50).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id != 3:
            n, hit, n_items, digest, _ = want[r.doc_id]
            assert (r.n_words, sum(s.end - s.start for s in r.spans), len(r.item_ids)) == (n, hit, n_items)
            assert decontam.items_digest(r.item_ids) == digest
    assert decontam.scan(d, b.limit(0)).where("size(spans) > 0").count() == 0
    assert decontam.scan(d.limit(0), b).count() == 0
    small = list(decontam.item_blocks(b, 10, block_words=5))
    assert len(small) > 1


def test_removal_leaves_the_rest(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two, THREE! And the end.", 39, "k"), (2, None, None, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, spans string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminated(docs, items).collect()}
    assert got[1].text == "Keep this. ! And the end." and got[1].n_chars == 25
    assert got[2].text is None and got[3].text == "clean" and got[3].n_chars == 5
    assert got[1].spans == "k"


def test_items_without_id_are_removed_too(spark):
    docs = spark.createDataFrame([(1, "Keep one two, three end"), (2, "one two three"), (3, "four five"), (4, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "four five")], "item_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.item_ids) for r in decontam.scan(docs, items).collect()}
    assert got == {1: ([(1, 4)], []), 2: ([(0, 3)], []), 3: ([(0, 2)], ["7"]), 4: ([], [])}
    left = {r.doc_id: r.text for r in decontam.decontaminated(docs, items).collect()}
    assert left == {1: "Keep  end", 2: "", 3: "", 4: "clean"}
