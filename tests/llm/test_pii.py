import hashlib
import random
import re

import pytest

from tidebar.llm import pii
from tidebar.llm.common import table
from tidebar.llm.queries import op1_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, span):
    d = re.sub("[^0-9]", "", span)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in span.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    found = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return sorted(found)


def said(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = op1_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        assert set(said(want).split(",")) <= set(r.spans.split(","))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 20


def test_random_strings_against_brute_force(spark):
    rng = random.Random(7)
    parts = ["a", "b.c", "@", "@x.de", "1", "23", "4.5", "256", ".", "..", "-", " ", "+", "+1 ", "(555)", "4111 1111 1111 1111", "é", "\U0001f600", "_", "%", "1.2.3.4", "5500005555555559", "\n", "9" * 18]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(1500)]
    rows += [(9001, "a" * 60_000), (9002, "1 " * 30_000), (9003, "+" + "1" * 50_000), (9004, "x@" * 20_000), (9005, "1.2.3.4 " * 300), (9006, "7" * 60_000)]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i != 9001 and i != 9004:
            assert got[i] == [(s, k, e) for s, k, e in brute(text)], text[:200]
    assert got[9001] == [] and got[9004] == []


def test_zero_octets_against_brute_force(spark):
    texts = ["10.0.0.1", "192.168.0.1", "0.0.0.0", "1.2.3.000", "from 0010.0.00.255 on", "1.2.3.00256", "0.0.0.256", "0.0.0", "0" * 4_000 + ".0.0.1", "0." * 20_000, "10.0.0.1 and 127.0.0.1:80"]
    rng = random.Random(9)
    texts += ["".join(rng.choice(["0", "00", "0.", ".0", ".", "1", "25", "6", " ", "10.0"]) for _ in range(rng.randrange(4, 16))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t[:200]
    assert [len(got[i]) for i in range(9)] == [1, 1, 1, 1, 1, 0, 0, 0, 1]
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()}[10] == "[IP] and [IP]:80"


LOOSE = [
    "Please write, e-mail jane.doe [at] example [dot] com today",
    "email me: bob (at) mail.example.org please",
    "call our phone (415) 555-0133 now",
    "tel 00 33 555-010-9999 x",
    "host 10[.]20[.]30[.]40 is up",
    "card 4111.1111.1111.1111 was charged",
]
CLEAN = ["version 1.2.3 of 2024", "order 123-456-78901 and page 12", "it is at home [dot] ok", "isbn 9780-306-40615-7", "no. 0000.0000.1111.2222"]


def test_classifier_adds_spans_and_leaves_clean_texts(spark):
    rows = [(i, t) for i, t in enumerate(LOOSE * 5 + CLEAN * 5)] + [(100 + i, f"mail x{i}@example.com or +1 (212) 555-01{i:02d}") for i in range(20)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(bool(got[i].spans) for i, t in rows[:55] if t in LOOSE)
    assert hits >= 20
    assert not any(got[i].spans for i, t in rows[:55] if t in CLEAN)


def test_form_vote_takes_zero_octets(spark):
    spans = spark.createDataFrame([("10[.]0[.]0[.]1",), ("10[.]20[.]30[.]40",), ("10[.]20[.]30[.]400",)], "span string")
    said = spans.selectExpr("named_struct('kind', 1, 'span', span, 'before', 'host ') as s").selectExpr(pii.votes("s")[0])
    assert [r[0] for r in said.collect()] == [1, 1, -1]


def test_reliabilities_follow_agreement():
    patterns = [(0, True, (1, 1, 1, 1), 500), (0, False, (1, 1, 1, 1), 100), (0, False, (-1, -1, -1, 1), 100), (0, False, (1, 1, 0, -1), 30)]
    post = pii.expectation_maximisation(patterns)
    assert post[1] > 0.9 and post[2] < 0.1
    w = pii.fit_classifier(patterns, post)
    assert all(x > 0 for x in w[1:3])


def test_redaction_and_edges(spark):
    rows = [(1, "I am a@b.de, at 1.2.3.4!", "de", 24, 0), (2, None, None, 0, 1), (3, "", "x", 0, 2), (4, "clean", "x", 5, 3), (4, "clean", "x", 5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long, base_ int")
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert got[1].text == "I am [EMAIL], at [IP]!" and got[1].n_chars == 22 and got[1].spans == "de"
    assert got[2].text is None and got[3].text == "" and got[4].text == "clean"
    assert pii.redacted(docs).count() == 5 and pii.redacted(docs).columns == docs.columns
    assert pii.digests(pii.find(docs.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "+1 (212) 555-0100 4111111111111111 a@b.co 9.9.9.9"])
def test_redaction_takes_all_base_spans(spark, text):
    out = pii.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].text
    assert not brute(out)


def test_redaction_ends_only_where_nothing_is_left(spark):
    """Each cut of these texts leaves a new match, 6, 9 and 13 times over."""
    texts = [
        "4.+1.2.3.4 4111 1111 1111 1111.1.21.3.4 4111 1111 1111 11113.41.2.3.4 41111111 1111 1111.1111 1111 1111.1.2.3.4",
        "+1+111.2.3.4 4111 1111 1111 1111.1.2.3.4 41 11 1111 1111 1111.1.2.3.4 4111 1111 11111111.41.2.3.4 4111 1111 1111 1111.14.5.2.3.234",
        "4.+1.2.3.4 4111 1111 1111 1111.1.21.3.4 4111 1111 111-1 11113.41.2.3.4 4111 11111111 1111.1.2.3.4 411-1 1111 1111 1111.1.2.3.4 4111 11111111 1111.1.2.3.4 411-1 1-111 1111 1111.1.2.3.4",
    ]
    rows = [(i, t, None, "left", 0) for i, t in enumerate([*texts, "clean", None, "a@b.de"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, left_ string, doc string, n_chars int")
    found = pii.redacted(docs)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows) and not any(brute(r.text) for r in got.values())
    assert [got[3].text, got[4].text, got[5].text] == ["clean", None, "[EMAIL]"] and all(r.n_chars == len(r.text) for r in got.values() if r.doc_id in (0, 1, 2, 5))
    assert got[2].text.startswith("4.") and all(r.doc == "left" and r.left_ is None for r in got.values())


def test_many_spans_in_a_text_against_brute_force(spark):
    """Thousands of spans, many blocks of them: places, candidates that touch none of the base spans, and what redaction leaves."""
    rng = random.Random(3)
    parts = ["a@b.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (212) 555-0100", "word", "é\U0001f600", "10[.]20[.]30[.]40", "x\n", "call (415) 555-0133 now"]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (255, 256, 257, 700, 9_000)] + ["1.2.3.4 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = pii.train(docs)
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    left = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    for i, text in enumerate(texts):
        base, spans = [tuple(s) for s in found[i].base], [tuple(s) for s in found[i].spans]
        assert base == brute(text) and spans == sorted(spans) and set(base) <= set(spans)
        more = [s for s in spans if s not in set(base)]
        assert not any(b[0] < s[2] and s[0] < b[2] for s in more[:200] for b in base)
        out, at = [], 0
        for start, kind, end in spans:
            if start >= at:
                out += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
            at = max(at, end)
        cut = "".join([*out, text[at:]])
        assert left[i] == cut or brute(cut), i  # cut once more only where what a cut leaves matches anew
    assert len(weights) == 5 and len(found[5].base) == 20_000
