import textwrap

import duckdb

from tidebar.llm import licences
from tidebar.llm.common import table
from tidebar.llm.queries import op6_licence_scans


def brute(text):
    sets = {k: licences.bigrams(t) for k, t in licences.TEMPLATES.items()}
    text = text or ""
    units = [text, *(text.split("\n") if "\n" in text else [])]
    out = []
    for k, unit in enumerate(units):
        s = {b for b in _grams(unit)}
        for name, t in sets.items():
            if s and (d := 2000 * len(s & t) // (len(s) + len(t))) >= licences.LEAST:
                out.append((k, name, d))
    return sorted(out)


def _grams(unit):
    import re

    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), unit))
    return zip_words(words)


def zip_words(words):
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_passages(text):
    """Every window of each template's length that begins at one of its bigrams."""
    import re

    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams, out = zip_words(words), []
    for name, template in sorted(licences.TEMPLATES.items()):
        t, n = licences.bigrams(template), len(licences.normalised(template))
        found = []
        for p, g in enumerate(grams):
            if g in t:
                s = set(grams[p : p + n - 1])
                found.append((-(2000 * len(s & t) // (len(s) + len(t))), p))
        if found and -min(found)[0] >= licences.LEAST:
            out.append((name, -min(found)[0], min(found)[1]))
    return out


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in op6_licence_scans(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = brute(t)
        assert got[i].n_matches == len({k for k, _, _ in want})
        assert got[i].licences == ",".join(sorted({n for _, n, _ in want}))
        best = min(want, key=lambda m: (-m[2], m[1]), default=(0, None, None))
        assert (got[i].best_licence, got[i].best_dice) == best[1:]
        inside = brute_passages(t)
        assert got[i].passage_licences == ",".join(n for n, _, _ in inside)
        first = min(inside, key=lambda m: (-m[1], m[0]), default=(None, None, None))
        assert (got[i].passage_licence, got[i].passage_dice, got[i].passage_start) == first
    assert any(r.n_matches for r in got.values())


def test_oracle_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(licences.oracle_sql()).fetchall())
    assert sorted(tuple(r) for r in op6_licence_scans(spark, sf).collect()) == want


def test_texts_edges_and_bounds(spark):
    mit = licences.TEMPLATES["mit-text"]
    rows = [(1, mit.upper(), 1), (2, "intro\n" + licences.TEMPLATES["mit"] + "\n" + licences.TEMPLATES["mit"], 1), (3, None, 1), (4, "", 1), (5, "license", 1), (6, mit + " and a few words more", 1), (7, "Released under the license of MIT. " * 4000, 1), (8, "'quoted' it's", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, units int")
    got = {r.doc_id: [(m.unit, m.licence, m.dice) for m in r.matches] for r in licences.scan(docs).collect()}
    assert all(got[i] == brute(t) for i, t, _ in rows)
    assert got[1] == [(0, "mit-text", 1000)] and len(got[2]) >= 2
    assert licences.scan(docs.limit(0)).count() == 0 and licences.scan(docs.union(docs)).count() == 16
    for n in range(1, 60):
        low, high = licences.size_bounds(n)
        for m in range(1, 130):
            if 2000 * min(n, m) // (n + m) >= licences.LEAST:
                assert low <= m <= high


def test_passages_within_longer_texts(spark):
    t = licences.TEMPLATES
    around = "some other words stand here and there of the text to the end\n" * 40
    rows = [(k, around + textwrap.fill(t[name], 80) + "\n" + around) for k, name in enumerate(sorted(t))]
    n = len(rows)
    rows += [(n, "one sentence more. " + t["mit"] + " and others after it"), (n + 1, t["isc"].replace("hereby", "thus")), (n + 2, "of the " * 30_000), (n + 3, t["mit-text"][:300]), (n + 4, None), (n + 5, ""), (n + 6, (t["mit"] + " ") * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(m.licence, m.dice, m.start) for m in r.passages] for r in licences.scan(docs).collect()}
    for i, text in rows:
        assert got[i] == brute_passages(text)
    for k, name in enumerate(sorted(t)):
        assert (name, 1000) in {(m, d) for m, d, _ in got[k]}
    assert got[n][0] == ("mit", 1000, 3) and got[n + 1][0][1] < 1000 and got[n + 6] == [("mit", 1000, 0)]
    assert got[n + 2] == got[n + 4] == got[n + 5] == []
