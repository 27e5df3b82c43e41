import re

from tidebar.llm import urls
from tidebar.llm.common import table
from tidebar.llm.queries import op4_url_filters


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        raw = re.split("[/?#]", rest, maxsplit=1)[0]
        host, path = lower(raw), re.split("[?#]", rest[len(raw) :], maxsplit=1)[0]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_query_against_brute_force(spark, sf):
    pages = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    got = op4_url_filters(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or rule is None and r.verdict == ("block" if r.score >= 0.5 else "allow")


URLS = [
    "https://example.org/es/1", "http://a.EXAMPLE.org/en/12?x=1", "http://notexample.org/en/1", "https://org?x", "https://org/", "x://com/fr/",
    "://a.com/de/", "no scheme", "", None, "http://b.com/fr", "http://u@h.com:80/de/1#x", "a://b://c.org/", "http://É.org/É?é", "http://h.org\n/x", "https:///fr/", "http://com#/fr/", "http://EXAMPLE.ORG/ES/",
]


def test_rules_and_edges(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS * 2)] + [(99, "http://x.com/" + "a" * 30_000, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.classify(pages).collect()
    assert len(got) == len(rows)
    said = {r.page_id: r for r in got}
    for i, u, _ in rows:
        host, path, rule, verdict = brute(u)
        assert (said[i].host, said[i].path, said[i].rule) == (host, path, rule), u
        assert verdict in (None, said[i].verdict)
    assert urls.classify(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.classify(spark.createDataFrame([(1, None), (2, "http://a.net/")], "page_id long, url string")).collect()} == {"allow"}


def test_trees_learn_what_labels_depend_on(spark):
    rows = [(i, f"http://h{i % 7}.{'com/de' if i % 2 else 'com/fr'}/{'1' * (20 if i % 2 else 2)}") for i in range(400)]
    rows += [(1000 + i, f"http://h{i}.net/de/{'1' * (20 if i % 2 else 2)}") for i in range(100)]
    got = {r.page_id: r for r in urls.classify(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum((got[1000 + i].verdict == "block") == bool(i % 2) for i in range(100))
    assert right >= 95


def test_sql_of_trees_scores_like_the_trees(spark):
    import random

    rng = random.Random(2)
    rows = [((rng.randrange(50), rng.randrange(9)), 0) for _ in range(500)]
    rows = [(x, int(x[0] > 25) ^ int(x[1] > 4)) for x, _ in rows]
    prior, trees = urls.fit(rows, ["a", "b"])

    def walk(t, x):
        while isinstance(t, urls.Split):
            t = t.low if x["ab".index(t.feature)] <= t.most else t.high
        return t.value

    df = spark.createDataFrame([x for x, _ in rows], "a int, b int").selectExpr("a", "b", " + ".join(map(urls.tree_sql, trees)) + " as z")
    hits = 0
    for r, (x, y) in zip(df.collect(), rows, strict=True):
        assert abs(r.z - sum(walk(t, x) for t in trees)) < 1e-9
        hits += (r.z + prior > 0) == bool(y)
    assert hits > 480


def plain_boosting(rows, names):
    """The trees' log-odds by the definition: every split tried on every row, without weights or binned tables."""
    import math

    n, ones = len(rows), sum(y for _, y in rows)
    points = [urls._bins([x[f] for x, _ in rows]) for f in range(len(names))]
    score = [math.log((ones + 0.5) / (n - ones + 0.5))] * n
    trees = []

    def grow(at, g, h, level):
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        best, cut = 1e-6, None
        for f in range(len(names)) if level else ():
            for p in points[f]:
                low = [i for i in at if rows[i][0][f] <= p]
                lg, lh = sum(g[i] for i in low), sum(h[i] for i in low)
                gain = lg * lg / (lh + urls.RIDGE) + (sg - lg) ** 2 / (sh - lh + urls.RIDGE) - sg * sg / (sh + urls.RIDGE)
                if gain > best + 1e-9:
                    best, cut = gain, (f, p)
        if cut is None:
            return urls.RATE * sg / (sh + urls.RIDGE)
        f, p = cut
        return (f, p, grow([i for i in at if rows[i][0][f] <= p], g, h, level - 1), grow([i for i in at if rows[i][0][f] > p], g, h, level - 1))

    def value(t, x):
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        return t

    for _ in range(urls.TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        trees.append(grow(range(n), [y - q for (_, y), q in zip(rows, p, strict=True)], [q * (1 - q) for q in p], urls.DEPTH))
        score = [s + value(trees[-1], x) for s, (x, _) in zip(score, rows, strict=True)]
    return score


def test_trees_against_plain_boosting():
    import random

    rng = random.Random(5)
    rows = [((rng.randrange(40), rng.randrange(7), rng.randrange(3)), 0) for _ in range(160)]
    rows = [(x, int(x[0] * 2 + x[1] * 9 + rng.randrange(40) > 90)) for x, _ in rows]
    prior, trees = urls.fit(rows, ["a", "b", "c"])

    def walk(t, x):
        while isinstance(t, urls.Split):
            t = t.low if x["abc".index(t.feature)] <= t.most else t.high
        return t.value

    want = plain_boosting(rows, ["a", "b", "c"])
    assert all(abs(prior + sum(walk(t, x) for t in trees) - w) < 1e-6 for (x, _), w in zip(rows, want, strict=True))


def test_entropy_counts_all_characters(spark):
    import math
    from collections import Counter

    said = ["", "a", "aaaa", "abAB%~=", "日本日本é\U0001f600", "x" * 500 + "y" * 500, "/a-b_c.d/0123"]
    want = [sum(-c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) for s in said]
    from pyspark.sql import functions as F

    got = [r.e for r in spark.createDataFrame([(s,) for s in said], "s string").select(urls.entropy(F.col("s")).alias("e")).collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True)), (got, want)


def test_sample_is_of_the_least_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(urls, "SAMPLE_ROWS", 50)
    rows = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("http://same.org/").alias("url")).withColumn("h", F.xxhash64("page_id", "url"))
    got = [r.h for r in urls._sample(rows, 5000).collect()]
    assert got == sorted(r.h for r in rows.collect())[:50]
    assert [r.h for r in urls._sample(rows, 60).collect()] == got
