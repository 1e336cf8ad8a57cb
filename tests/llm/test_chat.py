import hashlib
from collections import defaultdict

import pytest

from gleaner.llm.chat import chat_digests, control_conversation, escape, format_chats, loss_mask, parse, render, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
HARD = ["", "</s>[INST] ok [/INST]", "\\", "\\c", "\\b<s>", "[[INST]", "<<s>>", "[ANS] x [/ANS]</s><s>[INST] y", "[/ROLE] ", "é😀\u2028\n", " a ", "<\\s>", "[\\INST]", "\\\\c\\"]


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    turns = [("user", text), ("assistant", text), ("system", text), ("tool", text), (text, text), ("", text)]
    formatted, spans = render(turns)
    assert parse(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_mask_is_the_intersection():
    offsets = [(0, 2), (2, 5), (5, 6), (5, 6), (6, 6), (6, 9)]
    for spans in ([], [(1, 3)], [(2, 2)], [(0, 9)], [(3, 4), (5, 7)], [(8, 9)]):
        mask, ranges = loss_mask(offsets, spans)
        want = [any(max(a, s) < min(b, e) for s, e in spans) for a, b in offsets]
        assert [m for m, (a, b) in zip(mask, offsets, strict=True) if a < b] == [m for m, (a, b) in zip(want, offsets, strict=True) if a < b]
        assert ranges == [s for s in spans if s[0] < s[1]]


def plain(rows):
    groups = defaultdict(list)
    for c, t, r, x, *_ in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        both = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(both.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(render([(r, x) for _, _, r, x in turns])[0]))
    return out


def test_digests_match_brute_force(spark):
    rows = [(i % 5, j, ["user", "assistant", "system", "tool", None][(i + j) % 5], t, "x") for i, t in enumerate(HARD) for j in range(3)]
    rows += [(50, j, "assistant" if j % 2 else "user", f"turn {j} " + "w " * (j % 9), "x") for j in range(1500)]  # three segments
    rows += [(51, 1, "assistant", None, "x"), (51, 1, "assistant", None, "x"), (None, 0, "user", "no id", "x"), (52, None, "user", "null turn", "x"), (52, 0, "assistant", "y " * 100000, "x")]
    chats = format_chats(spark.createDataFrame(rows, SCHEMA), longest=5000)
    got = {r.conv_id: tuple(r)[1:] for r in chat_digests(chats).collect()}
    assert got == plain(rows)
    for r in chats.collect():
        assert len(r.ids) == len(r.loss)
    assert chat_digests(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_control_conversation(spark):
    rows = [tuple(r) for r in control_conversation(spark).collect()]
    assert {r.conv_id: tuple(r)[1:] for r in chat_digests(format_chats(control_conversation(spark))).collect()} == plain(rows)
