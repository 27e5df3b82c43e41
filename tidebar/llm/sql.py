"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lengths WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.i, a.n, x.item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM places) a JOIN phrases x ON a.n = x.n AND a.phrase = x.phrase),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS said FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.said, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
""".replace("{words}", _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ') || '  '] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
meets AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT u, v FROM meets JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u, v FROM both_ UNION SELECT r.u, e.v FROM reach r JOIN both_ e ON r.v = e.u),
least_ AS (SELECT u, min(v) AS v FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.v, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_ l ON l.u = d.doc_id
""".replace("{words}", _WORDS.format(r"[^ \t\n\x0B\f\r]+"))

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, r)
),
e AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>|:\n')) AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped) + count(*) * (4 + 2 + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _merkle(levels: int, top_levels: int) -> str:
    """The manifest with its levels written out, up to 16^levels rows of a source and 16^top_levels sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 bit by bit: each byte comes in at the first of its eight steps
    octets = "list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({octets}, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"
    parts = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, {crc} % 5 = 0 AS tampered FROM documents)",
        f"l AS MATERIALIZED (SELECT rid, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf('text')} AS leaf, CASE WHEN tampered THEN {leaf('lowered')} END AS changed FROM d)",
        "n0 AS MATERIALIZED (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY tree) AS w, leaf AS digest, rid FROM l)",
        "p0 AS (SELECT rid, n0.tree, i, w, '' AS proof, coalesce(changed, leaf) AS folded FROM n0 JOIN l USING (rid))",
    ]

    def climb(k: int) -> list[str]:
        before, after = "coalesce(array_to_string(digests[1:i % 16], ''), '')", "coalesce(array_to_string(digests[i % 16 + 2:], ''), '')"
        return [
            f"r{k} AS MATERIALIZED (SELECT tree, i // 16 AS run, w, list(digest ORDER BY i) AS digests FROM n{k} WHERE w > 1 GROUP BY ALL)",
            f"n{k + 1} AS MATERIALIZED (SELECT tree, run AS i, (w + 15) // 16 AS w, sha256(array_to_string(digests, '')) AS digest FROM r{k} UNION ALL SELECT tree, i, w, digest FROM n{k} WHERE w = 1)",
            f"p{k + 1} AS (SELECT rid, p.tree, i // 16 AS i, (p.w + 15) // 16 AS w, CASE WHEN p.w = 1 THEN proof ELSE proof || {before} || {after} END AS proof, CASE WHEN p.w = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded FROM p{k} p LEFT JOIN r{k} r ON r.tree = p.tree AND r.run = p.i // 16)",
        ]

    for k in range(levels):
        parts += climb(k)
    # the sources' roots are the bottom of the top tree
    top = levels + 1
    parts += [f"n{top} AS MATERIALIZED (SELECT 0 AS tree, tree AS i, count(*) OVER () AS w, digest FROM n{levels})", f"p{top} AS (SELECT rid, 0 AS tree, p.tree AS i, (SELECT count(*) FROM n{levels}) AS w, proof, folded FROM p{levels} p)"]
    for k in range(top, top + top_levels):
        parts += climb(k)
    end = top + top_levels
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, s.digest AS subroot, n{end}.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = n{end}.digest AS verified FROM p{end} JOIN l USING (rid) JOIN n{levels} s ON s.tree = l.tree, n{end}"


MERKLE = _merkle(6, 4)

HARD_NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
