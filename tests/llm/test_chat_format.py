import hashlib

import pytest
from hypothesis import given, strategies as st

from dripline.llm.chat_format import (
    END,
    TEXT,
    TURN,
    UNIT_TOKENS,
    escape,
    format_turn,
    format_turns,
    loss_spans,
    read_back,
    read_turns,
    unescape,
)

pieces = st.sampled_from(
    ["<|turn|>", "<|text|>", "<|end|>", "<|image:0|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<",
     "|", ">", "[", "]", "/", "s", "INST", "end", "\n", "a", "é", "😀", " "]
)
words = st.lists(pieces, max_size=12).map("".join)


@given(words)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = escape(text)
    assert unescape(escaped) == text
    for control in ("<|", "</s>", "<s>", "[INST]", "[/INST]"):
        assert control not in escaped


@given(st.lists(st.tuples(words, words), max_size=5))
def test_turns_are_read_back(turns):
    formatted = "".join(format_turn(role, text, UNIT_TOKENS)[0] for role, text in turns)
    assert list(read_turns(formatted)) == turns


@given(st.lists(st.tuples(st.sampled_from(["text", "image"]), words), max_size=6))
def test_parts_next_to_each_other(parts):
    content = [{"type": kind, "text": text, "ref": "r", "units": None} for kind, text in parts]
    formatted, attachments, tokens = format_turn("user", content, UNIT_TOKENS)
    expected = "".join(text for kind, text in parts if kind == "text")
    assert list(read_turns(formatted)) == [("user", expected)]
    n = sum(kind == "image" for kind, _ in parts)
    assert [x["number"] for x in attachments] == list(range(n)) and tokens == n * 256


def test_placeholders_and_expanded_tokens():
    parts = [
        {"type": "text", "text": "see "},
        {"type": "image", "ref": "a.png", "units": 2.0},
        {"type": "audio", "ref": "b.wav", "units": 1.5},
        {"type": "table", "ref": "c.pdf"},
        None,
        {"type": None, "text": None},
    ]
    formatted, attachments, tokens = format_turn("user", parts, UNIT_TOKENS)
    assert formatted == f"{TURN}user{TEXT}see <|image:0|><|audio:1|><|document:2|>{END}"
    assert [(x["kind"], x["ref"], x["tokens"]) for x in attachments] == [
        ("image", "a.png", 512), ("audio", "b.wav", 38), ("document", "c.pdf", 600)
    ]
    assert tokens == 1150


def test_loss_spans_cover_what_the_assistant_says():
    turns = [("user", "q"), ("assistant", "a</s>"), ("assistant", "b")]
    formatted = "".join(format_turn(role, text, UNIT_TOKENS)[0] for role, text in turns)
    learned = "".join(unescape(formatted[start:end]) for start, end in loss_spans(formatted))
    assert learned == "a</s>b"


def expected(rows):
    """Digests of (conversation, turn, role, text) rows, by the contract."""
    out = {}
    for conversation in {row[0] for row in rows}:
        own = [(t, r or "", x or "") for c, t, r, x in rows if c == conversation]
        own.sort(key=lambda x: (x[0] is not None, x[0], format_turn(x[1], x[2], UNIT_TOKENS)[0]))
        loss = "".join(text for _, role, text in own if role == "assistant")
        turns = "".join(f"{role}\n{text}\n" for _, role, text in own)
        out[conversation] = (
            len(own),
            hashlib.sha256(turns.encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def test_conversations_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "x"),
        (1, 1, "assistant", "x"), (1, None, "system", "s"), (2, 0, None, "</s>"),
        (2, 1, "assistant", "long " * 50_000), (None, 0, "user", "nobody"), (3, 5, "", ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = read_back(format_turns(frame.selectExpr("*", "'x' AS formatted", "1 AS learned")))
    assert {
        row["conv_id"]: (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"])
        for row in found.collect()
    } == expected(rows)
    assert read_back(format_turns(frame.limit(0))).collect() == []


def test_typed_parts_in_a_table(spark):
    frame = spark.sql(
        "SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array("
        "named_struct('type', 'text', 'text', 'a', 'ref', cast(null AS string), 'units', 0D),"
        "named_struct('type', 'image', 'text', null, 'ref', 'u', 'units', 3D)) AS text"
    )
    row = format_turns(frame).collect()[0]
    assert row["added_tokens"] == 768 and row["attachments"][0]["ref"] == "u"
    assert read_back(format_turns(frame)).collect()[0]["n_turns"] == 1


@pytest.mark.parametrize(
    ("units", "tokens"), [(None, 7), (float("nan"), 7), (float("inf"), 7), (-float("inf"), 7), (-2.0, 0), (1.5, 11)]
)
def test_units_that_are_no_number_count_once(units, tokens):
    part = {"type": "image", "text": None, "ref": "r", "units": units}
    _, attachments, added = format_turn("user", [part], {"image": 7})
    assert attachments[0]["tokens"] == added == tokens
