import random
import re

import numpy as np
import pytest

from tidebar.llm import jaccard
from tidebar.llm.common import table
from tidebar.llm.components import components
from tidebar.llm.queries import op8_ngram_jaccard_join


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    boss = {i: i for i in sets}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    meets = {(a, b) for ids in by_shingle.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in meets:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            boss[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def said(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = op8_ngram_jaccard_join(spark, sf).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert sum(i != c for i, (_, c) in want.items()) > 20


def edited(rng, words, share):
    return " ".join(rng.choice(["zz", "yy", "xx"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("docs_a_bucket", [40, 8192])
def test_clusters_chains_and_shared_passages(spark, monkeypatch, docs_a_bucket):
    """Near copies at all distances, chains, many documents with one passage, and small sets; also where few keys may be paired."""
    monkeypatch.setattr(jaccard, "BUCKET_DOCS", docs_a_bucket)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = []
    for n in (1, 2, 4, 5, 6, 8, 12, 20, 40, 90, 250):
        base = say(n)
        texts += [" ".join(base), " ".join(base).upper()]
        texts += [edited(rng, base, s) for s in (0.01, 0.02, 0.03, 0.04, 0.06, 0.1)]
        for cut in range(1, 6):
            texts.append(" ".join(base[: max(1, n - cut * n // 30)]))
    chain = say(200)
    texts += [" ".join(chain[i * 14 : i * 14 + 120]) for i in range(5)]
    passage = say(60)
    texts += [" ".join(say(rng.randrange(5, 60)) + passage + say(rng.randrange(5, 60))) for _ in range(60)]
    cluster = say(100)
    texts += [edited(rng, cluster, 0.02) for _ in range(60)]
    texts += ["a b c d e f g"] * 40 + [None, "", " \n"]
    rng.shuffle(texts)
    rows = [(i * 7 % 100_003, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, n long").repartition(3)
    assert said(jaccard.near_duplicates(docs)) == brute([(i, t) for i, t, _ in rows])


def test_linking_pairs_share_a_key():
    """The pigeonhole: two sets at the very threshold share one of their segment keys."""
    rng = np.random.default_rng(4)
    for trial in range(300):
        a = int(rng.integers(1, 400))
        b = int(rng.integers(a, max(a + 1, 4 * a // 3 + 1)))
        both = -(-3 * (a + b) // 7)
        if both > a or 100 * both < 75 * (a + b - both):
            continue
        pool = rng.integers(0, 1 << 63, a + b - both, dtype=np.int64).astype(np.uint64)
        x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:both], pool[a:]]))
        kx = {k for band, d in jaccard.configurations(len(x)) for k in jaccard.segment_keys(x, band, d)[0].tolist()}
        ky = {k for band, d in jaccard.configurations(len(y)) for k in jaccard.segment_keys(y, band, d)[0].tolist()}
        assert kx & ky, (trial, a, b)
        assert jaccard.hamming(jaccard.bit_sketch(x), jaccard.bit_sketch(y)) <= jaccard.most_different(a, b)


def test_one_of_each_and_edges(spark):
    rows = [(5, "a b c d e f", "k"), (3, "A B c d e f", "k"), (3, "A B c d e f", "k"), (9, None, "k"), (None, "a b c d e f", "k"), (11, "", "k"), (12, "other words in here now", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, 3, 9, 11, 12]
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == 7 and [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0


def test_candidates_share_as_many_keys_as_a_link_asks_for():
    """Two sets at the threshold share 1 + the lesser spare of the keys of the configuration they meet in."""
    rng = np.random.default_rng(8)
    for trial in range(300):
        a = int(rng.integers(20, 700))
        b = int(rng.integers(a, 4 * a // 3 + 1))
        both = min(a, -(-3 * (a + b) // 7))
        pool = rng.integers(0, 1 << 63, a + b - both, dtype=np.int64).astype(np.uint64)
        x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:both], pool[a:]]))
        kx = {band: jaccard.segment_keys(x, band, d) for band, d in jaccard.configurations(len(x))}
        ky = {band: jaccard.segment_keys(y, band, d) for band, d in jaccard.configurations(len(y))}
        band = jaccard.band(a)
        met = len(set(kx[band][0].tolist()) & set(ky[band][0].tolist()))
        assert met >= 1 + min(kx[band][1], ky[band][1]), (trial, a, b)


def test_codes_hold_sizes():
    for n in [*range(1, 3000, 7), 10**6 + 17, 10**9 + 1]:
        code = np.asarray([jaccard.class_code(n, 12345 * n)], dtype=np.uint64)
        low, high = jaccard.code_sizes(code)
        assert low[0] <= n <= high[0] and high[0] - low[0] <= n / 500 and not int(code[0]) & jaccard.BELOW


def test_an_id_that_repeats_with_another_text_loses_none(spark):
    rows = [(5, None, "a"), (5, "one two three four five six", "b"), (3, "ONE two three four five six", "c"), (5, "seven eight nine ten eleven twelve", "d"), (5, "seven eight nine ten eleven twelve", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = [(r.doc_id, (r.text or "").lower()) for r in jaccard.one_of_each(docs).collect()]
    assert len(kept) == 3 and {t for _, t in kept} == {"", "one two three four five six", "seven eight nine ten eleven twelve"}


def test_a_very_long_text_and_its_near_copy(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-9000])), (3, " ".join(long[:60_000]))]
    assert said(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    boss = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            boss[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in boss} and len(got) == len(boss)
