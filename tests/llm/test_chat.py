"""Chat formatting: the round trip of any text, masks, long conversations, and the query against plain Python."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cirrostrat.llm import chat, common

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<", "[", "/", "s>", "\\", "<\\s>", "<\\\\/s>", "[\\INST]", "INST]", "a", "\n", "é😀", "|"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Digests by conversation in plain Python."""
    out = {}
    for conv, *turn in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((turn[1] or "", turn[2] or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    t = chat.Template()
    made = [t.rendered(role, text) for role, text in turns]
    whole = "".join(m for m, _, _ in made)
    assert [(r, x) for r, x, _, _ in t.parse(whole)] == turns
    for (m, begin, end), (_, text) in zip(made, turns, strict=True):
        assert t.plain(m[begin:end]) == text
        assert "<|endoftext|>" not in m and "</s>" not in m[:end] and "<s>" not in m[1:]


def test_other_templates():
    t = chat.Template(open="<|im_start|>", middle="<|sep|>", close="<|im_end|>", others=("<|endoftext|>",), escape="~")
    texts = ["<|im_end|>", "<~|im_end|>", "<|sep|><|im_start|>", "plain", "<|endoftext|>"]
    assert [x for _, x, _, _ in t.parse("".join(t.rendered("user", x)[0] for x in texts))] == texts
    assert t.rendered("user", "plain < text")[0] == "<|im_start|>user<|sep|>plain < text<|im_end|>"  # nothing that doesn't conflict is touched
    for wrong in ({"escape": "s"}, {"escape": "\\\\"}, {"close": "[/INST]"}, {"middle": "<"}, {"others": ("<<s>",)}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_parser_refuses_what_is_no_conversation():
    t = chat.Template()
    for text in ("x", "<s>[INST]user", "<s>[INST]user[/INST]a", "<s>[INST]user</s>", "<s>[INST]user[/INST]a</s>b", "</s>"):
        with pytest.raises(ValueError):
            t.parse(text)


def test_mask_and_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b"), (1, None, "system", None), (1, 1, "assistant", "a</s>b"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 5, "assistant", "long " * 100000), (3, 4, "assistant", ""), (4, -3, "user", "\x00")]
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 as part", "2 as record", "3 as loss")
    records = common.stored(chat.format_chats(df), "t")
    for r in records.collect():
        assert "".join(chat.Template().plain(r.text[s.start : s.end]) for s in r.loss) == "".join(x for role, x, _, _ in chat.Template().parse(r.text) if role == "assistant")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(records).collect()}
    assert got == plain(rows)
    assert chat.format_chats(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_long_conversations_are_several_records(spark, monkeypatch):
    monkeypatch.setattr(chat, "RECORD_CHARS", 200)
    rows = [(c, t, "assistant" if t % 2 else "user", f"[INST] {t} </s>") for c, n in ((7, 10000), (8, 3), (9, 5000)) for t in range(n)]
    rows += [(7, 17, "user", "again")] * 3
    records = common.stored(chat.format_chats(spark.createDataFrame(rows, CONVERSATIONS).repartition(5)), "t")
    assert records.where("conv_id = 7").select("part").distinct().count() == 3
    assert max(len(r.text) for r in records.collect()) <= 200
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(records).collect()} == plain(rows)
