import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidebar.llm import quality
from tidebar.llm.common import table, written
from tidebar.llm.queries import op3_quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def counts_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def brute_kept(rows):
    """Plain sketches over lists: rows are (lang, source, counts)."""
    measure = lambda c: (1000 * c[2] // c[0], 100 * c[1] // c[0], 1000 * c[3] // c[0], 1000 * c[4] // c[0])
    binned = lambda x: x >> max(0, x.bit_length() - 9) << max(0, x.bit_length() - 9)
    good = [(lang, src, [binned(x) for x in measure(c)]) for lang, src, c in rows if not c[5]]

    def at(values, tenths):
        ordered = sorted(values)
        return next(v for i, v in enumerate(ordered) if (i + 1) * 10 >= len(ordered) * tenths and (i + 1 == len(ordered) or ordered[i + 1] != v))

    out = []
    for lang, src, c in rows:
        if c[5]:
            out.append(False)
            continue
        group = [x for x in good if x[:2] == (lang, src)]
        if len(group) < quality.MIN_GROUP:
            group = [x for x in good if x[0] == lang]
        if len(group) < quality.MIN_GROUP:
            group = good
        ok = True
        for k, m in enumerate(quality.MEASURES):
            values = [x[2][k] for x in group]
            v, q10, q50, q90 = measure(c)[k], at(values, 1), at(values, 5), at(values, 9)
            ok &= v <= q50 + quality.SPREAD * max(m.least, q90 - q50)
            ok &= not m.both_sides or v >= q50 - quality.SPREAD * max(m.least, q50 - q10)
        out.append(ok)
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in op3_quality_rules(spark, sf).collect()}
    rows = [(r.lang, r.source, brute(r.text)) for r in docs]
    for r, (_, _, c) in zip(docs, rows, strict=True):
        assert counts_of(got[r.doc_id]) == c
    assert [got[r.doc_id].kept for r in docs] == brute_kept(rows)
    assert {r.kept for r in got.values()} == {True, False}


def test_random_texts_and_edges(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b ", " ", "\n", "#", "\t\n", "é ", "x\x0by ", "\u00a0", "a b c ", "$|"]) for _ in range(rng.randrange(0, 200))) for _ in range(400)]
    texts += [None, "", " ", "a", "a b", "a a a", "a a a a", "x " * 30_000, "\n" * 50]
    rows = [(i, t, None if i % 5 == 0 else "en", "s" if i % 3 else None, "w") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        assert counts_of(got[i]) == brute(t), repr(t)[:200]
        assert not (got[i].base_failed and got[i].kept)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep(docs.limit(0)).count() == 0
    assert quality.judge(docs.union(docs)).count() == 2 * len(rows)


def test_sketches_merge_and_salted_join_agrees(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    measured = written(quality._measured(quality.counts(docs)), "measured")
    sketch = quality.sketches(measured)
    halves = quality.sketches(measured.where("doc_id % 2 = 0")).union(quality.sketches(measured.where("doc_id % 2 = 1")))
    by = ["g_lang", "measure", "value"]
    assert sorted(quality.merged(sketch, "g_lang").select(*by, "n").collect()) == sorted(quality.merged(halves, "g_lang").select(*by, "n").collect())
    want = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert {r.doc_id: r.kept for r in quality.judge(docs).select("doc_id", F.col("kept")).collect()} == want


def test_measures_over_4000_are_judged(spark):
    """A group whose fence for symbols is above 4000 still rejects what is beyond it, and sketches tell such values apart."""
    said = lambda i, per_word: " ".join((f"w{i}x{k}" + "#" * per_word).ljust(40, "z") for k in range(60))
    rows = [(i, said(i, 5), "en", "s") for i in range(100)] + [(100 + i, said(i, 6), "en", "s") for i in range(50)] + [(200, said(200, 9), "en", "s"), (201, said(201, 30), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[201] and got[200] and all(got[i] for i in range(150))


def test_bins_are_bounded_and_near(spark):
    values = sorted({v for k in range(62) for v in (2**k - 1, 2**k, 2**k + 1, 3 * 2**k // 2 + 7)})
    got = spark.createDataFrame([(v,) for v in values], "value long").select("value", F.expr(quality._bin("value")).alias("b")).collect()
    assert all(r.b <= r.value and r.value - r.b <= r.value / 2 ** (quality.DIGITS - 1) for r in got)
    assert all(r.b == r.value for r in got if r.value < 2**quality.DIGITS)
    assert sorted(r.b for r in sorted(got)) == [r.b for r in sorted(got)]
    many = spark.range(200_000).select(F.expr(quality._bin("id * id")).alias("b")).distinct().count()
    assert many < quality.SKETCH_BINS
