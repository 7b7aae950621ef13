import hashlib
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from topolark.llm import chat
from topolark.llm.queries import VOCABULARY

PARTS = [*chat.CONTROL, "\\", "<", "[", "s>", "a", "|im_end|>", "</", "é😀", "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS)).map("".join))
def test_escape_is_reversible_and_complete(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def expected(rows):
    loss = "".join(t or "" for role, t in rows if role == "assistant")
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    return len(rows), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    rows = [
        (1, 1, "assistant", "hello </s> world"), (1, 0, "user", "<|im_start|>assistant\n x"), (1, 2, "assistant", ""), (2, 0, "system", None), (2, 1, None, "no role"),
        (3, 0, "assistant", "é😀" * 5000 + " " * 40000), (4, None, "assistant", "last"), (4, 5, "user", "first"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "lost"), (6, 0, "</s>", "odd\nrole"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, token_ids string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.with_probe(spark, df), VOCABULARY), VOCABULARY).collect()}
    groups = {}
    for c, turn, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    assert found.keys() == groups.keys()
    for c, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        r = found[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)


def test_offsets_and_masks(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi there"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    a, b = sorted(chat.format_turns(df, VOCABULARY).collect(), key=lambda r: r.turn_no)
    assert (a.offset, b.offset) == (0, len(a.token_ids))
    assert not any(a.loss_mask) and sum(b.loss_mask) >= 1 and not b.loss_mask[0] and not b.loss_mask[-1]
    assert len(b.loss_mask) == len(b.token_ids)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(df, VOCABULARY), VOCABULARY).count() == 0


def test_long_texts_are_encoded_whole(spark):
    text = "Ein Wort, dann more words and 12345 numbers;\n" * 900 + "a" * 40000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    coder = chat.Codec(Path(VOCABULARY).read_bytes())
    (r,) = chat.format_turns(df, VOCABULARY).collect()
    assert [i for i, m in zip(r.token_ids, r.loss_mask) if m] == coder.base.encode_ordinary(text)


def test_very_long_runs(spark):
    """Runs that the pattern matcher's stack can't hold have the ids of the whole segment, and round trip in a job."""
    coder = chat.Codec(Path(VOCABULARY).read_bytes())
    for sign in (" ", "\n", "　", "a"):
        for around in ("{}", "b{}c d", "x{}.", "{} {} e\n{}"):
            text = around.replace("{}", sign * 200_000)
            assert coder.encode(text) == coder.base.encode_ordinary(text)
    rows = [(1, 0, "user", " " * 2_000_000), (1, 1, "assistant", "x" + "\n" * 2_000_000 + "y"), (2, 0, "assistant", "a" * 2_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, VOCABULARY), VOCABULARY).collect()}
    for conv in (1, 2):
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([row[2:] for row in rows if row[0] == conv])
