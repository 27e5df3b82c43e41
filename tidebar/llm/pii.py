r"""Personal data: exact base patterns, and further spans by weak supervision.

Native: DataFrame and SQL functions only. Base matches (email, ip, card, phone)
always count. Looser candidates (defanged addresses, spelled-out at and dot,
national phone numbers, card numbers with other separators) are voted on by
labelers: the form's own regular expression, gazetteers (top-level domains,
issuer and country prefixes, reserved networks), cue words of the context, and
what touches the span. Votes of all candidates and base matches are counted by
pattern over the whole table; expectation-maximisation over those few counts
estimates each labeler's reliability; a logistic span classifier, trained on
the posteriors, accepts the candidates that no base match overlaps.

Defined cases: null and empty texts have no spans; spans are in code points;
repeated rows are judged alike; with no candidates the classifier accepts
nothing; an empty table gives an empty result. Extra columns are carried by
redacted() and not read otherwise.

The patterns are those of the contract with possessive loops and a look-behind
that starts a search only where a run of the first class starts (or where the
last match ended), so that long runs take linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40
ACCEPT = 0.8
EM_ROUNDS, FIT_ROUNDS = 50, 400
#: Spans of a text that are folded at once.
BLOCK = 256

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?i:at|@)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[(?i:dot)\])[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9._/-])[0-9]{4}+([._/]|--|\x20\x20)[0-9]{4}+\1[0-9]{4}+\1[0-9]{2,4}+(?![0-9])",
    "phone": r"(?<![0-9+(./-])(?:00[1-9][0-9]{0,2}+[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without these can't have a match of the kind.
NEEDS = {"email": "(?i)@|[(\\[]at", "ip": r"[0-9](?:\.|[(\[])", "card": "[0-9]", "phone": "[0-9]"}

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Cue words of each kind within the text before a span, and cues of other numbers.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reply|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|from|client|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay(?:ment)?|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|sms|telefon|tel[eé]fono)\b",
}
_OTHER_NUMBER = r"(?i)\b(?:isbn|issn|doi|order|invoice|version|ver|ref|no|nr|id|sku|serial|page|pp|section|lat|lon)\b[\x20.:#]*\z"

_SPAN = "struct<kind:int,start:int,end:int,span:string,before:string,base:boolean>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _digits(span: str) -> str:
    return rf"regexp_replace({span}, r'[^0-9]+', '')"


def _luhn(d: str) -> str:
    """SQL: whether the digits d, of which there are few, pass the check sum."""
    doubled = "2 * v - if(v > 4, 9, 0)"
    digit = f"cast(substring({d}, length({d}) - i, 1) as int)"
    return f"aggregate(transform(sequence(0, length({d}) - 1), i -> transform(array({digit}), v -> if(i % 2 = 1, {doubled}, v))[0]), 0, (s, v) -> s + v) % 10 = 0"


def _valid(kind: str, span: str) -> str:
    d = _digits(span)
    if kind == "ip":
        return rf"{span} rlike r'\A{_OCTET}(?:\.{_OCTET}){{3}}\z'"
    if kind == "card":
        return f"if(length({d}) between 14 and 19, {_luhn(d)}, false)"
    if kind == "phone":
        return f"length({d}) between 10 and 15"
    return "true"


def _blocks(x: str) -> str:
    """SQL: the array x, a column or a lambda's variable, in blocks of BLOCK; an empty one in one empty block.

    Folds append to arrays by copying them; blocks keep what is copied short.
    """
    return f"transform(sequence(0, cast((size({x}) - 1) div {BLOCK} as int)), k_ -> slice({x}, k_ * {BLOCK} + 1, {BLOCK}))"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _matches(text: str, kind: str, pattern: str, base: bool) -> str:
    """SQL: an array of spans; the text between matches tells their places."""
    pairs = f"zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (p, m) -> named_struct('p', p, 'm', m))"
    start = "b.at + length(x.p)"
    span = f"named_struct('kind', {KINDS.index(kind)}, 'start', {start}, 'end', {start} + length(x.m), 'span', x.m, 'before', right(x.p, {CONTEXT}), 'base', {str(base).lower()})"
    inner = f"""aggregate(block_, named_struct('at', a.at, 'out', {_NONE}),
        (b, x) -> named_struct('at', {start} + coalesce(length(x.m), 0), 'out', if(x.m is null, b.out, array_append(b.out, {span}))))"""
    outer = f"""flatten(aggregate({_blocks("pairs_")}, named_struct('at', 0, 'out', cast(array() as array<array<{_SPAN}>>)),
        (a, block_) -> {_let("r_", inner, "named_struct('at', r_.at, 'out', array_append(a.out, r_.out))")}, a -> a.out))"""
    return f"if({text} rlike r'{NEEDS[kind]}', {_let('pairs_', pairs, outer)}, {_NONE})"


def base_spans_sql(text: str) -> str:
    """SQL: the valid base matches of all kinds."""
    each = [f"filter({_matches(text, k, BASE[k], True)}, s -> {_valid(k, 's.span')})" for k in KINDS]
    return f"concat({', '.join(each)})"


def base_spans(text: str = "text") -> Column:
    return F.expr(base_spans_sql(text))


def loose_spans(text: str, base: str) -> Column:
    """Candidates beyond the base matches in the column base, none of them overlapping one."""
    each = [_matches(text, k, LOOSE[k], False) for k in KINDS]
    # a block's reach spares looking at its spans one by one
    reach = f"transform({_blocks(base)}, s_ -> named_struct('lo', array_min(s_.start), 'hi', array_max(s_.end), 's', s_))"
    meets = "exists(reach_, g_ -> g_.lo < c.end and c.start < g_.hi and exists(g_.s, b -> b.start < c.end and c.start < b.end))"
    return F.expr(_let("reach_", reach, f"filter(concat({', '.join(each)}), c -> not coalesce({meets}, false))"))


def _vote(yes: str, no: str) -> str:
    return f"(case when {yes} then 1 when {no} then -1 else 0 end)"


def _by_kind(span: str, says: dict[str, str]) -> str:
    return f"(case {span}.kind " + " ".join(f"when {i} then {says[k]}" for i, k in enumerate(KINDS)) + " end)"


def votes(s: str) -> list[str]:
    """SQL of the labelers' votes on span s: 1 personal, -1 not, 0 abstains."""
    d = _digits(f"{s}.span")
    tld = rf"regexp_extract({s}.span, r'([A-Za-z]+)[\])]?\z', 1)"
    form = _by_kind(s, {
        "email": _vote(rf"{s}.span rlike r'[A-Za-z]' and length({tld}) between 2 and 24", f"length({tld}) < 2"),
        "ip": _vote(rf"regexp_replace({s}.span, r'[^0-9]+', '.') rlike r'\A{_OCTET}(?:\.{_OCTET}){{3}}\z'", "true"),
        "card": _vote(_valid("card", f"{s}.span"), "true"),
        "phone": _vote(rf"{s}.span rlike r'\A(?:\+|00|\()' and length({d}) between 10 and 15", f"length({d}) not between 10 and 15"),
    })
    gazetteer = _by_kind(s, {
        "email": _vote(f"lower({tld}) in ('com', 'org', 'net', 'edu', 'gov', 'info', 'io', 'de', 'fr', 'es', 'uk', 'eu')", "false"),
        "ip": _vote(rf"not {s}.span rlike r'\A(?:0|127|255)[^0-9]'", "true"),
        "card": _vote(rf"{d} rlike r'\A(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))'", rf"{d} rlike r'\A0'"),
        "phone": _vote(rf"{d} rlike r'\A(?:00)?(?:1|33|34|44|49)?[2-9][0-9]{{2}}'", rf"{d} rlike r'\A0{{3}}'"),
    })
    cue = _by_kind(s, {k: _vote(f"{s}.before rlike r'{CUES[k]}'", f"{s}.before rlike r'{_OTHER_NUMBER}'") for k in KINDS})
    touch = _vote(rf"{s}.before = '' or {s}.before rlike r'[\s(:,;<\"]\z'", rf"{s}.before rlike r'[A-Za-z0-9_$#=/.-]\z'")
    return [form, gazetteer, cue, touch]


def vote_counts(docs: DataFrame) -> DataFrame:
    """kind, base, v0.., n: how often each pattern of votes occurs over all texts; at most 8 * 3^4 rows."""
    found = docs.where(F.expr(f"text rlike r'{NEEDS['card']}' or text rlike r'{NEEDS['email']}'")).select("text", base_spans().alias("base_"))
    spans = found.select(F.explode(F.concat("base_", loose_spans("text", "base_"))).alias("s"))
    said = spans.select("s.kind", "s.base", *[F.expr(v).alias(f"v{i}") for i, v in enumerate(votes("s"))])
    return said.groupBy(said.columns).agg(F.count("*").alias("n"))


def expectation_maximisation(patterns: list[tuple[int, bool, tuple[int, ...], int]]) -> list[float]:
    """Each pattern's probability of being personal data.

    A two-class model per kind: a labeler that votes is right with its
    reliability, which all kinds share. Base matches are known to be personal.
    """
    labelers = range(len(patterns[0][2])) if patterns else ()
    right = {j: 0.8 for j in labelers}
    prior = {k: 0.5 for k in range(len(KINDS))}
    post: list[float] = []
    for _ in range(EM_ROUNDS):
        post = []
        for kind, base, v, _n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(x * math.log(right[j] / (1 - right[j])) for j, x in enumerate(v))
            post.append(1.0 if base else 1 / (1 + math.exp(-odds)))
        for j in labelers:
            agree = sum(n * (p if v[j] > 0 else 1 - p) for (_, _, v, n), p in zip(patterns, post, strict=True) if v[j])
            said = sum(n for _, _, v, n in patterns if v[j])
            right[j] = min(0.98, max(0.55, (agree + 8) / (said + 10)))
        for k in prior:
            loose = [(n, p) for (kind, base, _, n), p in zip(patterns, post, strict=True) if kind == k and not base]
            prior[k] = min(0.9, max(0.1, (sum(n * p for n, p in loose) + 1) / (sum(n for n, _ in loose) + 2)))
    return post


def fit_classifier(patterns: list[tuple[int, bool, tuple[int, ...], int]], posterior: list[float]) -> list[float]:
    """Logistic regression on votes: bias, then a weight for each labeler; patterns weigh by the logarithm of their counts."""
    width = len(patterns[0][2]) if patterns else 4
    w = [-1.0] + [0.5] * width
    for _ in range(FIT_ROUNDS if patterns else 0):
        grad, mass = [0.0] * (width + 1), 0.0
        for (_, _, v, n), p in zip(patterns, posterior, strict=True):
            x = (1, *v)
            error = p - 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            weight = math.log1p(n)
            mass += weight
            for i, b in enumerate(x):
                grad[i] += weight * error * b
        w = [a + 0.5 * g / mass - 0.0005 * a for a, g in zip(w, grad, strict=True)]
    return w


def train(docs: DataFrame) -> list[float]:
    rows = vote_counts(docs.select("text")).collect()
    patterns = sorted((r["kind"], r["base"], tuple(r[f"v{i}"] for i in range(4)), r["n"]) for r in rows)
    return fit_classifier(patterns, expectation_maximisation(patterns))


def accepts(weights: list[float], s: str) -> str:
    """SQL: whether the classifier takes span s."""
    z = " + ".join([f"{weights[0]!r}D", *[f"{w!r}D * {v}" for w, v in zip(weights[1:], votes(s), strict=True)]])
    return f"(({z}) >= {math.log(ACCEPT / (1 - ACCEPT))!r}D)"


def _with_spans(docs: DataFrame, weights: list[float], *columns: str) -> DataFrame:
    """columns, text, base_ (base spans) and spans_ (all spans by start, then kind)."""
    has = F.expr(f"text rlike r'{NEEDS['card']}' or text rlike r'{NEEDS['email']}'")
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    rows = docs.select(*columns, F.when(has, base_spans()).otherwise(none).alias("base_"), *([] if "text" in columns else ["text"]))
    rows = rows.select("*", F.when(has, loose_spans("text", "base_")).otherwise(none).alias("loose_"))
    order = lambda c: F.expr(f"array_sort(transform({c}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end)))")
    rows = rows.withColumn("taken_", F.expr(f"filter(loose_, c -> {accepts(weights, 'c')})"))
    return rows.select(*columns, "text", order("base_").alias("base_"), order("concat(base_, taken_)").alias("spans_")) if "text" not in columns else rows.select(*columns, order("base_").alias("base_"), order("concat(base_, taken_)").alias("spans_"))


def _said(c: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({c}, s -> concat_ws(':', array({names})[s.kind], cast(s.start as string), cast(s.end as string))), ',')"


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans as arrays of (start, kind, end), kind an index of KINDS."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _with_spans(rows, train(rows), "doc_id").select("doc_id", F.col("base_").alias("base"), F.col("spans_").alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(_said("base")), 256).alias("base_sha256"), F.expr(_said("spans")).alias("spans"))


def _cut(text: str, spans: str) -> str:
    """SQL: text with every span replaced by its kind in brackets; overlapping spans become one."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    # places are counted within the text of a block, as finding a place takes the time of the text before it
    here = f"substring({text}, a.at + 1, greatest(a.at, coalesce(array_max(block_.end), 0)) - a.at)"
    inner = f"""aggregate(block_, named_struct('at', a.at, 'out', cast(array() as array<string>)),
        (b, s) -> named_struct('at', greatest(b.at, s.end), 'out', if(s.start < b.at, b.out, concat(b.out, array(substring(here_, b.at - a.at + 1, s.start - b.at), array({names})[s.kind])))))"""
    block = _let("here_", here, _let("r_", inner, "named_struct('at', r_.at, 'out', array_append(a.out, array_join(r_.out, '')))"))
    return f"""array_join(aggregate({_blocks(spans)}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, block_) -> {block}, a -> array_append(a.out, substring({text}, a.at + 1))), '')"""


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with all spans replaced by their kinds; n_chars follows the text.

    What a cut leaves may match anew (digits that were part of a longer, failing
    match), and so may what is left then. Base spans are cut until no text has
    any: the texts are written after three cuts, and the few that still have
    some are cut and written again. Every cut takes a match's digits or its @
    away, so that this ends.
    """
    fields = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*fields).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = _with_spans(rows, train(rows), "doc").withColumn("some_", F.size("spans_") > 0)
    found = found.withColumn("text", F.when(F.col("some_"), F.expr(_cut("text", "spans_"))))
    for _ in range(2):
        found = _cut_again(found, F.col("some_"))
    new = {"text": F.when(F.col("some_"), F.col("text")).otherwise(F.col("doc.text")).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("some_"), F.length("text").cast(kind)).otherwise(F.col("doc.n_chars")).alias("n_chars")
    cut = found.select(F.struct(*[new.get(c, F.col(f"doc.`{c}`").alias(c)) for c in docs.columns]).alias("doc"), (F.col("some_") & (F.size(_base("text")) > 0)).alias("left_"))
    done = cut = written(cut, "redacted")
    while not cut.where("left_").isEmpty():
        again = _cut_again(cut.where("left_").select("doc", F.col("doc.text").alias("text")), F.lit(True))
        kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
        doc = F.col("doc").withField("text", F.col("text"))
        doc = doc.withField("n_chars", F.length("text").cast(kind)) if kind else doc
        cut = written(again.select(doc.alias("doc"), (F.size(_base("text")) > 0).alias("left_")), "redacted")
        done = done.where("not left_").unionByName(cut)
    return done.select("doc.*")


def _base(c: str) -> Column:
    return F.expr(f"array_sort(transform({base_spans_sql(c)}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end)))")


def _cut_again(rows: DataFrame, some: Column) -> DataFrame:
    """The base spans of text cut, where some."""
    return rows.withColumn("spans_", F.when(some, _base("text"))).withColumn("text", F.when(some, F.expr(_cut("text", "spans_"))))
