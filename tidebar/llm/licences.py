r"""Licence scans: texts and their lines against licence templates by Dice over word bigrams.

A text is normalised to lower-case words of letters and digits. The whole text
and each of its lines are units; a unit's set of word bigrams is compared to
each template's by Dice, 2 * common / (sizes' sum). A Dice of t needs sizes
within t / (2 - t) of each other, so templates of other sizes are pruned before
anything is compared, and so are units that share no bigram with a template. A
unit of one word has no bigrams and matches nothing.

Notices wrapped over lines or standing within a longer text are found as
passages: windows over the whole text's words, of a template's own length and
beginning at one of its bigrams. Of each template the best window is given.

Native: DataFrame and SQL functions. Templates are few and fixed, so their
bigrams are literals of the plan and nothing is shuffled.

Defined cases: null and empty texts match nothing; ties go to the template
whose name sorts first, and among a template's windows to the first; a window
that the text's end cuts short counts with the words it has; repeated rows are
scanned row by row; a unit's repeated bigrams count once; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least Dice of a match, in thousandths.
LEAST = 700

#: Licence notices, fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def normalised(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> set[str]:
    words = normalised(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def size_bounds(n: int, least: int = LEAST) -> tuple[int, int]:
    """Sizes that a set of n bigrams can have a Dice of least thousandths with."""
    return -(-least * n // (2000 - least)), (2000 - least) * n // least


def _words_sql(text: str) -> str:
    return f"filter(split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), x -> x <> '')"


def _pairs_sql(words: str, start: str, n: str) -> str:
    """Distinct bigrams of n words from the one-based start."""
    return f"array_distinct(array_compact(zip_with(slice({words}, {start}, {n} - 1), slice({words}, {start} + 1, {n} - 1), (a, b) -> concat(a, ' ', b))))"


def _listed(grams) -> str:
    return ", ".join(f"'{g}'" for g in sorted(grams))


def _passage_sql(name: str, template: str, hits: str, words: str, least: int) -> str:
    """The best window of a template in a text: of the template's length, beginning at one of its bigrams, the first among equals; null if none matches.

    hits are the places and bigrams of the template in the text, in order. A
    window holds no more different bigrams of the template than hits, so that
    one whose hit number low - 1 lies beyond its end is pruned unread.
    """
    n, length = len(bigrams(template)), len(normalised(template))
    low = size_bounds(n, least)[0]
    anchors = f"filter(transform({hits}, (h, i) -> named_struct('p', h.p, 'i', i)), x -> get({hits}, x.i + {low - 1}).p <= x.p + {length - 2})"
    common = f"size(array_distinct(transform(filter(slice({hits}, x.i + 1, {length - 1}), k -> k.p <= x.p + {length - 2}), k -> k.g)))"
    windows = f"transform({anchors}, x -> named_struct('dice', cast(2000 * {common} div ({n} + size({_pairs_sql(words, 'x.p + 1', str(length))})) as int), 'before', -x.p))"
    best = f"array_max(filter({windows}, x -> x.dice >= {least}))"
    return f"transform(filter(array({best}), b -> b is not null), b -> named_struct('licence', '{name}', 'dice', b.dice, 'start', -b.before))"


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, matches, passages, dice in thousandths.

    matches: array of (licence, unit, dice), unit 0 the whole text and k its k-th
    line; by unit, then licence. passages: array of (licence, dice, start), start
    the best window's first word from 0; by licence.
    """
    templates = templates or TEMPLATES
    sets = {name: bigrams(t) for name, t in sorted(templates.items()) if bigrams(t)}
    widest = max(size_bounds(len(s), least)[1] for s in sets.values())
    narrowest = min(size_bounds(len(s), least)[0] for s in sets.values())
    every = sorted(set().union(*sets.values()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a word of each template's rarest kind stands in every text that matches one: most texts end here
    hint = "(?i)" + "|".join(sorted({re.escape(max(normalised(b), key=len)) for s in sets.values() for b in s}))
    known = _listed(every)
    no_words, no_units = "cast(array() as array<string>)", "cast(array() as array<array<string>>)"
    rows = rows.select("doc_id", "text", F.when(F.col("text").rlike(hint), F.expr(_words_sql("text"))).otherwise(F.expr(no_words)).alias("w"))
    rows = rows.select("doc_id", "text", "w", F.expr(_pairs_sql("w", "1", "greatest(1, size(w))")).alias("grams"))
    # lines and passages have no bigram that their text hasn't: with fewer known ones than the least size bound, nothing in it matches
    rows = rows.select("doc_id", "text", "w", "grams", F.expr(f"size(filter(grams, g -> g in ({known}))) >= {narrowest}").alias("likely"))
    lines = f"transform(transform(split(text, '\\n'), u -> {_words_sql('u')}), v -> {_pairs_sql('v', '1', 'greatest(1, size(v))')})"
    units = f"if(likely, concat(array(grams), if(contains(text, '\\n'), {lines}, {no_units})), {no_units})"
    rows = rows.select("doc_id", F.expr(f"if(likely, w, {no_words})").alias("w"), F.expr(units).alias("units"))
    some = F.expr(
        f"""filter(transform(units, (s, i) -> named_struct('unit', i, 'size', size(s), 'common',
              if(size(s) between {narrowest} and {widest}, array_intersect(s, array({known})), cast(array() as array<string>)))),
            u -> size(u.common) > 0)"""
    )
    hits = F.expr(f"filter(transform(w, (x, i) -> named_struct('p', i, 'g', concat(x, ' ', get(w, i + 1)))), h -> h.g in ({known}))")
    rows = rows.select("doc_id", "w", some.alias("units"), hits.alias("hits"))
    mine = [F.expr(f"filter(hits, h -> h.g in ({_listed(s)}))").alias(f"hits_{k}") for k, s in enumerate(sets.values())]
    rows = rows.select("doc_id", "w", "units", *mine)
    passages = [_passage_sql(name, templates[name], f"hits_{k}", "w", least) for k, name in enumerate(sets)]
    each = []
    for name, s in sets.items():
        low, high = size_bounds(len(s), least)
        mine = ", ".join(f"'{b}'" for b in sorted(s))
        dice = f"2000 * size(array_intersect(u.common, array({mine}))) div (u.size + {len(s)})"
        each.append(f"transform(filter(units, u -> u.size between {low} and {high}), u -> named_struct('licence', '{name}', 'unit', u.unit, 'dice', cast({dice} as int)))")
    found = f"filter(concat({', '.join(each)}), m -> m.dice >= {least})"
    matches = F.expr(f"array_sort({found}, (a, b) -> case when a.unit < b.unit then -1 when a.unit > b.unit then 1 when a.licence < b.licence then -1 when a.licence > b.licence then 1 else 0 end)")
    return rows.select("doc_id", matches.alias("matches"), F.expr(f"concat({', '.join(passages)})").alias("passages"))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_matches (units that match), licences (sorted, comma-joined), best_licence and best_dice (thousandths); of passages licences, best licence, its dice and first word."""
    ranked = lambda c: f"array_sort({c}, (a, b) -> case when a.dice > b.dice then -1 when a.dice < b.dice then 1 when a.licence < b.licence then -1 when a.licence > b.licence then 1 else 0 end)"
    rows = found.select("doc_id", "matches", "passages", F.expr(ranked("matches")).alias("ranked"), F.expr(f"try_element_at({ranked('passages')}, 1)").alias("passage"))
    return rows.select(
        "doc_id",
        F.expr("cast(size(array_distinct(transform(matches, m -> m.unit))) as bigint)").alias("n_matches"),
        F.expr("array_join(array_sort(array_distinct(transform(matches, m -> m.licence))), ',')").alias("licences"),
        F.expr("try_element_at(ranked, 1).licence").alias("best_licence"),
        F.expr("cast(try_element_at(ranked, 1).dice as bigint)").alias("best_dice"),
        F.expr("array_join(transform(passages, m -> m.licence), ',')").alias("passage_licences"),
        F.col("passage.licence").alias("passage_licence"),
        F.col("passage.dice").cast("long").alias("passage_dice"),
        F.col("passage.start").cast("long").alias("passage_start"),
    )


def oracle_sql(templates: dict[str, str] | None = None, least: int = LEAST) -> str:
    """The summary of documents in DuckDB's SQL."""
    values = ", ".join(f"('{name}', '{b}')" for name, t in sorted((templates or TEMPLATES).items()) for b in sorted(bigrams(t)))
    lengths = ", ".join(f"('{name}', {len(normalised(t))})" for name, t in sorted((templates or TEMPLATES).items()))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH template(licence, gram) AS (VALUES {values}),
sizes AS (SELECT licence, count(*) AS n FROM template GROUP BY 1),
units AS (
  SELECT doc_id, 0 AS unit, coalesce(text, '') AS said FROM documents
  UNION ALL
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS unit, unnest(string_split(text, chr(10))) AS said
  FROM documents WHERE contains(text, chr(10))
),
words AS (SELECT doc_id, unit, regexp_extract_all({lower.format('said')}, '[a-z0-9]+') AS w FROM units),
grams AS (
  SELECT DISTINCT doc_id, unit, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram
  FROM words WHERE len(w) > 1
),
unit_sizes AS (SELECT doc_id, unit, count(*) AS n FROM grams GROUP BY 1, 2),
common AS (SELECT g.doc_id, g.unit, t.licence, count(*) AS n FROM grams g JOIN template t USING (gram) GROUP BY 1, 2, 3),
dice AS (
  SELECT c.doc_id, c.unit, c.licence, 2000 * c.n // (u.n + s.n) AS dice
  FROM common c JOIN unit_sizes u ON c.doc_id = u.doc_id AND c.unit = u.unit JOIN sizes s ON c.licence = s.licence
),
found AS (SELECT * FROM dice WHERE dice >= {least}),
best AS (SELECT doc_id, licence, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence) AS k FROM found),
said AS (SELECT doc_id, count(DISTINCT unit) AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM found GROUP BY 1),
lengths(licence, n_words) AS (VALUES {lengths}),
places AS (
  SELECT doc_id, unnest(range(0, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram
  FROM words WHERE unit = 0 AND len(w) > 1
),
hits AS (SELECT p.doc_id, p.p, t.licence, t.gram FROM places p JOIN template t USING (gram)),
shared AS (
  SELECT a.doc_id, a.licence, a.p, count(DISTINCT b.gram) AS n
  FROM hits a JOIN lengths l USING (licence) JOIN hits b ON a.doc_id = b.doc_id AND a.licence = b.licence AND b.p BETWEEN a.p AND a.p + l.n_words - 2
  GROUP BY 1, 2, 3
),
likely AS (SELECT h.doc_id, h.licence, h.p, h.n FROM shared h JOIN sizes s USING (licence) WHERE (2000 - {least}) * h.n >= {least} * s.n),
window_dice AS (
  SELECT k.doc_id, k.licence, k.p, 2000 * any_value(k.n) // (any_value(s.n) + count(DISTINCT q.gram)) AS dice
  FROM likely k JOIN lengths l USING (licence) JOIN sizes s USING (licence) JOIN places q ON k.doc_id = q.doc_id AND q.p BETWEEN k.p AND k.p + l.n_words - 2
  GROUP BY 1, 2, 3
),
passages AS (
  SELECT doc_id, licence, dice, p FROM window_dice WHERE dice >= {least}
  QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, p) = 1
),
passage AS (
  SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences, first(licence ORDER BY dice DESC, licence) AS licence,
         first(dice ORDER BY dice DESC, licence) AS dice, first(p ORDER BY dice DESC, licence) AS p
  FROM passages GROUP BY 1
)
SELECT d.doc_id, coalesce(s.n_matches, 0) AS n_matches, coalesce(s.licences, '') AS licences, b.licence AS best_licence, b.dice AS best_dice,
       coalesce(g.licences, '') AS passage_licences, g.licence AS passage_licence, g.dice AS passage_dice, g.p AS passage_start
FROM documents d LEFT JOIN said s ON d.doc_id = s.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id AND b.k = 1 LEFT JOIN passage g ON d.doc_id = g.doc_id
"""
