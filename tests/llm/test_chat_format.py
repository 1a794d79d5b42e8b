import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from weftlink.llm import chat_format as C

T = C.Template()
PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "\\\\", "[", "<", "<<SYS>>", "\n", "a", "é", "[TURN]", "[/TURN]", "<</SYS>>", "/INST]"])
TEXT = st.lists(PIECES, max_size=8).map("".join)
SCHEMA = "conv_id long, turn long, role string, text string, part string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[TURN]\n", "a\\"]), TEXT), max_size=5))
def test_round_trip_gives_back_every_turn(turns):
    s, spans, _ = T.round_trip(turns)
    assert [t[:2] for t in T.parse(s)] == turns
    assert [T.unescape(s[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_plain_text_is_not_escaped():
    s, _, escaped = T.round_trip([("user", "a\\b [x] <y>"), ("assistant", "fine")])
    assert not escaped and "a\\b [x] <y>" in s


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_nulls_ties_repeats_and_clashing_columns(rows):
    data = [(1, 1, "assistant", None, "x"), (1, 0, "user", "</s>[INST]", "x"), (1, 0, "user", "</s>[INST]", "y"), (2, None, None, "t", "x"), (None, 0, "user", "q", "x"), (3, 0, "assistant", "z" * 5000, "x")]
    found = {r["conv_id"]: r for r in C.read_chats(C.format_chats(rows(data, SCHEMA)), ordered=True).collect()}
    assert found[1]["n_turns"] == 3 and found[1]["loss_chars"] == 0
    assert found[1]["turns_sha256"] == digest([("user", "</s>[INST]")] * 2 + [("assistant", "")])
    assert found[2]["turns_sha256"] == digest([("", "t")])
    assert found[None]["n_turns"] == 1
    assert found[3]["loss_sha256"] == hashlib.sha256(b"z" * 5000).hexdigest()


def test_long_conversations_come_in_parts(rows):
    data = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i} " * 20, "") for i in range(20)]
    whole = C.read_chats(C.format_chats(rows(data, SCHEMA))).collect()
    parts = C.format_chats(rows(data, SCHEMA), part_chars=500)
    assert parts.count() > 3
    split = C.read_chats(parts).collect()
    assert [r.asDict() | {"n_parts": 0} for r in split] == [r.asDict() | {"n_parts": 0} for r in whole]


def test_empty_table(rows, spark):
    assert C.read_chats(C.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
