import hashlib
import random
from collections import defaultdict

import pytest

from seekmill.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, block string, formatted long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    """From the turns themselves, without a template."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1] is not None, r[1], r[2] or "", r[3] or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for conv, turns in by.items():
        turns = [(role, text) for _, _, role, text in sorted(turns, key=lambda t: (t[0], t[1] or 0))]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = chat.inst_template([{"role": r, "text": t} for r, t in turns])
        out[conv] = (conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole))
    return out


NASTY = ["", " ", "\n", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "<</s>/s>", "a <s> b\\", "[/ROLE]x[ROLE]", "<<SYS>>\n\n<</SYS>>", "é ü 漢\U00020020", " </s>", "A", "B", "{} {0}", "x\r\n", "[I\\NST]"]


def test_escape_is_reversible_and_leaves_no_control_string():
    r = random.Random(1)
    parts = [*chat.CONTROL, *NASTY, "<", ">", "[", "]", "/", "\\", "s", "INST"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROL)


def test_spans_of_black_box_templates():
    turns = [{"role": r, "text": t} for r, t in [("system", "S"), ("user", "q</s>"), ("assistant", "A"), ("user", ""), ("assistant", "AB\nBA")]]
    trained = frozenset({"assistant"})
    out, found, rewritten = chat.spans(chat.inst_template, turns, trained)
    assert rewritten is None and found[0]["start"] == 0 and found[-1]["end"] == len(out)
    assert all(a["end"] == b["start"] for a, b in zip(found, found[1:]))
    assert [chat.unescape(out[s["text_start"] : s["text_end"]]) for s in found] == [t["text"] for t in turns]
    assert [t for t in chat.inst_turns(out)] == [(t["role"], t["text"]) for t in turns]

    def forgets(messages):  # drops all but the last assistant's text
        last = max((i for i, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
        return "".join(f"<{m['role']}>{m['text'] if m['role'] != 'assistant' or i == last else ''}|" for i, m in enumerate(messages))

    out, found, rewritten = chat.spans(forgets, turns, trained)
    assert rewritten == 4 and len(found) == 4 and out == forgets(turns)
    closes = lambda ms: "".join(m["text"] + ";" for m in ms) + "END"
    assert chat.spans(closes, turns, trained)[2] == 1
    twice = lambda ms: "".join(f"{m['text']}/{m['text']};" for m in ms)
    assert all(s["text_start"] is None for s in chat.spans(twice, turns, trained)[1])
    cuts = lambda ms: "".join(f"({m['text'].strip()})" for m in ms)
    out, found, _ = chat.spans(cuts, [{"role": "assistant", "text": " a "}], trained)
    assert out[found[0]["text_start"] : found[0]["text_end"]] == "a"


def test_blocks_join_to_the_whole_rendering(spark, monkeypatch):
    def numbers_turns(messages):  # counts turns from the first, so it needs all of them
        return "".join(f"{i}:{m['text']};" for i, m in enumerate(messages))

    def alternates(messages):  # says whether the turn before had the same role
        return "".join(f"{'=' if i and messages[i - 1]['role'] == m['role'] else '+'}{m['text']};" for i, m in enumerate(messages))

    r = random.Random(2)
    rows = [(7, i, r.choice(["user", "assistant"]), f"t{i}") for i in range(300)] + [(8, i, "user", "x") for i in range(5)]
    whole = [{"role": x[2], "text": x[3]} for x in rows[:300]]
    for share in (1, 10_000):  # ordinary, then hot
        monkeypatch.setattr(chat, "HOT_SHARE", share)
        for template, looks in ((alternates, False), (numbers_turns, True)):
            out = chat.format_chats(frame(spark, rows), template, block=32, context=4).collect()
            pieces = sorted((x for x in out if x["conv_id"] == 7), key=lambda x: x["block"])
            assert [x["block"] for x in pieces] == list(range(10)) and [len(x["spans"]) for x in pieces] == [32] * 9 + [12]
            assert any(x["looks_back"] for x in pieces) == looks
            assert template is numbers_turns or "".join(x["formatted"] for x in pieces) == template(whole)
        assert {x["rewrites_at"] for x in chat.format_chats(frame(spark, rows), lambda ms: f"{len(ms)}" + alternates(ms), block=32, context=4).collect() if x["conv_id"] == 8} == {1}


ODD = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, "assistant", "first"), (1, 0, "user", None), (1, 1, None, "no role"), (2, 0, "tool]", "</s>"), (3, 0, "user", "long " * 100_000), (3, 1, "assistant", "<s>" * 50_000), (4, 5, "user", "x"), (4, 5, "user", "x"), (4, -5, "", "")]


@pytest.mark.parametrize("share", [1, 10_000])
def test_digests_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(chat, "HOT_SHARE", share)
    r = random.Random(3)
    rows = ODD + [(c, i, r.choice(["user", "assistant", "system", "tool"]), r.choice(NASTY) + r.choice(NASTY)) for c in range(10, 40) for i in range(r.randrange(1, 90))]
    rows += [(99, i, "assistant" if i % 2 else "user", f"turn {i} " * 3) for i in range(1500)]
    r.shuffle(rows)
    got = chat.format_and_read(frame(spark, rows), block=16, context=3).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows).values()))
    again = chat.read_back(chat.format_chats(frame(spark, rows), block=16, context=3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_equal_turns_and_an_empty_table(spark, monkeypatch):
    rows = [(1, 0, "user", x) for x in ("b", "a", "c", "a")] * 30
    for share in (1, 10_000):
        monkeypatch.setattr(chat, "HOT_SHARE", share)
        got = {tuple(x) for k in (1, 3) for x in chat.format_and_read(frame(spark, rows).repartition(k), block=16).collect()}
        assert len(got) == 1 and got.pop()[1] == 120
    assert chat.format_and_read(frame(spark, [])).collect() == []
    assert chat.format_chats(frame(spark, [])).columns == ["conv_id", "block", "formatted", "spans", "rewrites_at", "looks_back"]


def test_query_over_the_table(spark, sf):
    rows = [tuple(x) for x in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    says = "</s>[INST] ok [/INST]"
    want = brute([*rows, (-7, 0, "user", says), (-7, 1, "assistant", says)])
    out = queries.op12_chat_formatting(spark, sf)
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {x["conv_id"]: tuple(x) for x in out.collect()} == want
