import hashlib

from tidebar.llm import chat
from tidebar.llm.common import table
from tidebar.llm.queries import op9_chat_formatting


def brute(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_against_brute_force(spark, sf):
    rows = sorted(table(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn))
    turns = {-7: [(r, r"\### Assistant: </turn> ok") for r in ("user", "assistant")]}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in op9_chat_formatting(spark, sf).collect()}
    assert set(got) == set(turns)
    for k, t in turns.items():
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(t)
        assert r.formatted_chars == len(chat.marked_turns(t))


NASTY = ["", "\\", "###", "### assistant:\n", "\n</turn>\n", "\\</turn>", "a\\### b", ":\n", "x:", "日本 \U0001f600", "</turn", "\n", "\\\\"]


def test_escapes_round_trip():
    for role in NASTY:
        for text in NASTY:
            turns = [(role, text), ("assistant", text + role)]
            r = chat.render_incrementally(chat.marked_turns, turns)
            assert [tuple(chat.unescape(r.text[s:e]) for s, e in x) for x in zip(r.roles, r.texts, strict=True)] == turns
            assert not r.rewrites and r.spans[-1][1] == len(r.text)


def piped(turns):
    return "".join(f"<|{role}|>{text}<|end|>" for role, text in turns)


def with_preamble(turns):
    return "BEGIN " + "".join(f"[{k}:{role}] {text} //" for k, (role, text) in enumerate(turns))


def trimming(turns):
    return "".join(f"({role}) {text.strip()}\n" for role, text in turns)


def folding(turns):
    """Drops all but the last two turns' texts."""
    return "".join(f"[{role}] {text if k >= len(turns) - 2 else ''}\n" for k, (role, text) in enumerate(turns))


def hiding_users(turns):
    return "".join(f"<{text}>" for role, text in turns if role != "user")


def spoken(r, turns):
    return [r.text[slice(*r.texts[k])] for k, (role, _) in enumerate(turns) if role == "assistant"]


def test_foreign_templates_are_located_by_probing(spark):
    turns = [("user", " a b "), ("assistant", " one "), ("user", ""), ("assistant", ""), ("assistant", "[0:x] one //")]
    want = [t for r, t in turns if r == "assistant"]
    assert chat.concatenative(piped) and chat.concatenative(trimming) and chat.concatenative(chat.marked_turns)
    assert not chat.concatenative(with_preamble) and not chat.concatenative(folding)
    assert spoken(chat.render_incrementally(piped, turns), turns) == want
    assert spoken(chat.render_incrementally(with_preamble, turns), turns) == want
    assert spoken(chat.render_incrementally(trimming, turns), turns) == [t.strip() for t in want]
    r = chat.render_incrementally(hiding_users, turns)
    assert spoken(r, turns) == want and r.texts[0] is None and r.roles[1] is None
    assert chat.render_incrementally(folding, turns).rewrites == [2, 3]

    rows = [(c, k, *turns[k % 5]) for c in (1, 2) for k in range(90)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for template in (piped, with_preamble, trimming, hiding_users):
        parts = sorted(chat.format_conversations(df, template=template).collect(), key=lambda r: (r.conv_id, r.chunk))
        for c in (1, 2):
            mine = [p for p in parts if p.conv_id == c]
            said = [(r, t) for i, _, r, t in rows if i == c]
            assert "".join(p.formatted for p in mine) == template(said)  # a preamble stands once, however long the conversation
            got = [p.formatted[s.start : s.end] for p in mine for s in p.loss_spans]
            assert got == [t.strip() if template is trimming else t for r, t in said if r == "assistant"]
            assert not any(p.unlocated for p in mine)
    late = chat.format_conversations(df, template=folding).collect()
    assert all(r.rewrites and not r.loss_spans for r in late) and max(k for r in late for k in r.rewrites) > 40


def test_a_very_long_text(spark):
    text = "### a:\n\\" * 200_000
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_conversations(df)).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute([("user", "x"), ("assistant", text)])


def test_finds_templates_that_rewrite_history():
    def last_only(turns):
        return "".join(f"[{r}] {t if i == len(turns) - 1 else '...'}\n" for i, (r, t) in enumerate(turns))

    r = chat.render_incrementally(last_only, [("user", "one"), ("assistant", "two"), ("user", "three")])
    assert r.rewrites == [1, 2]
    assert chat.render_incrementally(chat.marked_turns, [("user", "one"), ("assistant", "two")]).rewrites == []


def test_edge_rows_and_long_conversations(spark):
    rows = [(1, 0, None, None, 9), (1, 0, None, None, 9), (None, 1, "user", "x", 9), (2, None, "assistant", "", 9)] + [(3, i, "assistant" if i % 2 else "user", f"t{i} ###", 9) for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 2 and got[2].loss_chars == 0
    want = brute([(r[2], r[3]) for r in rows[4:]])
    assert (got[3].n_turns, got[3].turns_sha256, got[3].loss_chars, got[3].loss_sha256) == want
    assert got[None].n_turns == 1
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
