"""Chat formatting with loss spans found by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.
Rendering successive turn prefixes and comparing consecutive outputs locates
each turn's span without knowing the template; a template whose longer output
doesn't start with the shorter one rewrites history, which is reported.

Where a turn's role and text stand is found likewise: the prefix is rendered
with pairs of sentinels in their place, and what the outputs of a pair share at
both ends is the layout around them. A turn whose rendering doesn't keep that
layout (a template that drops or moves it) is reported as not located.

Rows of a conversation are sorted within a task and streamed. A template whose
renderings of the probe conversations join like strings is concatenative; its
conversations are rendered in chunks of at most CHUNK_TURNS whose outputs follow
each other, each after the last turn of the one before, so that memory is one
chunk however long a conversation is, and a turn that doesn't join its
predecessor after all raises an error. Any other template gets each conversation
whole, of whatever length, as its output may depend on all of it: that costs the
square of the turns.

Defined cases: null texts and roles count as empty; equal or null turn numbers
are ordered by turn, role, text (nulls first); repeated rows are turns of their
own; a null conv_id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import small_batches

CHUNK_TURNS = 32
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Control strings of the default template; inside roles and texts their first character is escaped.
HEAD, HEAD_END, TURN_END = "### ", ":\n", "\n</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|:(?=\n)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Pairs that stand for a text and a role; no two begin or end alike.
SENTINELS = (("\ue000x\ue001", "\ue002y\ue003"), ("\ue004u\ue005", "\ue006v\ue007"))
_PROBES: tuple[list[Turn], ...] = ([("user", "one")], [("assistant", "two"), ("user", "")], [("system", " three\n"), ("assistant", "")], [("tool", "\\### x:\n")])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    r"""As texts; colons always, so that one at the role's end can't join the head's."""
    return re.sub(r"\\|###|</turn>|:", lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: `### role:`, the text, `</turn>`."""
    return "".join(f"{HEAD}{escape_role(role)}{HEAD_END}{escape(text)}{TURN_END}" for role, text in turns)


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)  # of each turn in text
    roles: list[tuple[int, int] | None] = field(default_factory=list)  # of each turn's role, None where it wasn't located
    texts: list[tuple[int, int] | None] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)  # turns whose arrival changed earlier output


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _between(a: str, b: str, now: str) -> tuple[int, int] | None:
    """What stands in now where the renderings a and b of two sentinels differ."""
    if a == b:
        return None
    head = _common(a, b)
    tail = min(_common(a[::-1], b[::-1]), min(len(a), len(b)) - head)
    if head + tail <= len(now) and now.startswith(a[:head]) and now.endswith(a[len(a) - tail :]):
        return head, len(now) - tail
    return None


def _located(template: Template, before: list[Turn], turn: Turn, now: str) -> list[tuple[int, int] | None]:
    """Where turn's role and text stand in now, the rendering of before and turn."""
    (a, b), (c, d) = SENTINELS
    role, text = turn
    pairs = ((c, text), (d, text)), ((role, a), (role, b))
    return [_between(*(template([*before, x]) for x in pair), now) for pair in pairs]


def render_incrementally(template: Template, turns: list[Turn], *, joins: bool = False) -> Rendered:
    """Renders every prefix; a turn's span is what its arrival adds after the common beginning. Turns of a concatenative template (joins) are located in their own renderings."""
    before, out = template([]), Rendered("")
    for k, turn in enumerate(turns):
        now = template(turns[: k + 1])
        begin = len(before) if now.startswith(before) else _common(before, now)
        if begin < len(before):
            out.rewrites.append(k)
            out.spans, out.roles, out.texts = ([x and (min(x[0], begin), min(x[1], begin)) for x in places] for places in (out.spans, out.roles, out.texts))
        out.spans.append((begin, len(now)))
        at = begin if joins else 0
        found = _located(template, [] if joins else turns[:k], turn, now[at:])
        for places, x in zip((out.roles, out.texts), found, strict=True):
            places.append((x[0] + at, x[1] + at) if x and x[0] + at >= begin else None)
        before = now
    out.text = before
    return out


def concatenative(template: Template) -> bool:
    """Whether renderings of the probe conversations, and nothing, join like strings."""
    if template([]) != "":
        return False
    return all(template([*a, *b]) == template(a) + template(b) for a in _PROBES for b in _PROBES) and all(template(a) == "".join(template([t]) for t in a) for a in _PROBES)


_SPAN = "array<struct<start:bigint,end:bigint,role_start:bigint,role_end:bigint,text_start:bigint,text_end:bigint>>"


def format_conversations(conversations: DataFrame, *, template: Template = marked_turns, loss_role: str = "assistant") -> DataFrame:
    """conv_id, chunk, formatted, spans, loss_spans (code points in formatted), rewrites and unlocated: one row per chunk of turns.

    Places of roles and texts are null where they weren't located; unlocated lists the turns of the loss role whose
    text wasn't. A rewritten conversation has no loss spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        joins = concatenative(template)
        for conv_id, number, part, last in _streamed(batches, CHUNK_TURNS if joins else None):
            if joins and template([*last, *part]) != "".join(template([t]) for t in [*last, *part]):
                raise ValueError("the template joins the probe conversations like strings, but not this one")
            r = render_incrementally(template, part, joins=joins)
            mine = [] if r.rewrites else [k for k, (role, _) in enumerate(part) if role == loss_role]
            loss = [r.texts[k] for k in mine if r.texts[k]]
            rows.append((conv_id, number, r.text, [(*s, *(a or (None, None)), *(b or (None, None))) for s, a, b in zip(r.spans, r.roles, r.texts, strict=True)], loss, r.rewrites, [k for k in mine if not r.texts[k]]))
            if len(rows) == 256:
                yield _formatted_batch(rows)
                rows.clear()
        if rows:
            yield _formatted_batch(rows)

    return _ordered(conversations).mapInArrow(run, f"conv_id long, chunk int, formatted string, spans {_SPAN}, loss_spans array<struct<start:bigint,end:bigint>>, rewrites array<int>, unlocated array<int>")


def _formatted_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = ("start", "end", "role_start", "role_end", "text_start", "text_end")
    kind = lambda n: pa.list_(pa.struct([(f, pa.int64()) for f in fields[:n]]))
    structs = lambda xs: [dict(zip(fields, x, strict=False)) for x in xs]
    ids, numbers, texts, spans, loss, rewrites, lost = zip(*rows, strict=True)
    columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(map(structs, spans), kind(6)), pa.array(map(structs, loss), kind(2)), pa.array(rewrites, pa.list_(pa.int32())), pa.array(lost, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "chunk", "formatted", "spans", "loss_spans", "rewrites", "unlocated"])


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return small_batches(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def _streamed(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[tuple[int | None, int, list[Turn], list[Turn]]]:
    """(conv_id, chunk number, at most size turns, the turn before them if any) of rows that come sorted."""
    now, number, part, last = None, 0, [], []
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
            if part and (conv_id != now or len(part) == size):
                yield now, number, part, last
                number, last, part = (number + 1, part[-1:], []) if conv_id == now else (0, [], [])
            now = conv_id
            part.append((role, text))
    if part:
        yield now, number, part, last


def digests(formatted: DataFrame, *, decode: Callable[[str], str] = unescape) -> DataFrame:
    """Reads formatted chunks back by their spans: counts and digests of turns and of the text under the loss mask, one row per conversation. decode undoes the template's escapes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def done() -> None:
            n, turns, chars, loss, length = state
            out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            for conv_id, text, spans, loss_spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans", "loss_spans")), strict=True):
                if state is None or conv_id != now:
                    if state is not None:
                        done()
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for span in spans:
                    role, said = (decode(text[span[f"{x}_start"] : span[f"{x}_end"]]) for x in ("role", "text"))
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss_spans:
                    said = decode(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[0] += len(spans)
                state[4] += len(text)
            if len(out) > 10_000:
                yield _digest_batch(out)
                out.clear()
        if state is not None:
            done()
            yield _digest_batch(out)

    rows = formatted.select("conv_id", "chunk", "formatted", "spans", "loss_spans")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)
