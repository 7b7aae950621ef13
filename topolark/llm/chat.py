"""Chat formatting by token-level assembly.

A conversation becomes a sequence of ids: for each turn a reserved start id, the ids of the role, a reserved
separator, the ids of the text and a reserved end id. Segments are encoded on their own with an ordinary
byte-level BPE, so that no reserved id can come out of a text; a loss mask covers exactly the text ids of the
trained role and is laid by prefix sums over the lengths of the segments. Where content holds one of the
template's control strings, it is escaped by a backslash behind the string's first sign (one more where some are
there already), which undoes exactly and leaves no control string in the content.

Conversations are dealt by id and sorted by turn inside their partition; rows are then streamed, so that a
conversation, however long, never has to fit in memory. Ids are returned per turn with their offset in
the conversation.

Nulls and ties: a null text or role counts as empty; rows are ordered by turn (nulls last), then role, then
text, so repeated rows stay as they are; rows with a null conversation id form one conversation. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolark.llm.common import bounded_batches

#: White space as the vocabulary's pattern takes it, in runs that its matcher's stack can't hold (it fails beyond some 600,000).
SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{100000,}")
#: How the byte-level vocabulary cuts a text before merging (fixed by the public vocabulary).
CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>"
#: Strings that a template may give a meaning; none holds another's first sign after its own first.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
TRAINED = "assistant"

_MARKED = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    return _MARKED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Codec:
    """Ordinary ids of a vocabulary of ranks, followed by three reserved ids."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.base = tiktoken.Encoding("chat", pat_str=CUTS, mergeable_ranks=table, special_tokens={})
        first = max(table.values()) + 1
        self.start, self.middle, self.end = first, first + 1, first + 2
        self.reserved = {self.start: START, self.middle: MIDDLE, self.end: END}

    def encode(self, text: str) -> list[int]:
        """Ids of the text. A long run of white space is cut off as the pattern would: all but its last sign, or all at the end."""
        ids, start = [], 0
        for run in SPACES.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.base.encode_ordinary(text[start : run.start()])
            ids += self.base._encode_single_piece(text[run.start() : end])
            start = end
        return ids + self.base.encode_ordinary(text[start:])

    def decode(self, ids: list[int]) -> str:
        return self.base.decode_bytes(ids).decode()


def assemble(coder: Codec, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn."""
    segments = [[coder.start], coder.encode(escape(role)), [coder.middle], coder.encode(escape(text)), [coder.end]]
    ends = list(accumulate(map(len, segments)))
    steps = np.zeros(ends[-1] + 1, np.int8)
    if role == TRAINED:
        steps[ends[2]] += 1
        steps[ends[3]] -= 1
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(steps)[:-1].astype(bool)


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, role and text, a conversation's rows together and in order."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text").select("conv_id", "role", "text")


def format_turns(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each turn: conv_id, turn_no (from 0), offset of its first id, token_ids and loss_mask.

    vocabulary: path of a file of byte-level ranks, read on the driver. Rows of a conversation come together and
    in order.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a public vocabulary, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, turn, offset = None, object(), 0, 0
        for batch in batches:
            coder, out = coder or Codec(shared.value), []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if conv != now:
                    now, turn, offset = conv, 0, 0
                ids, mask = assemble(coder, role, text)
                out.append((conv, turn, offset, ids, mask))
                turn, offset = turn + 1, offset + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_())))], ["conv_id", "turn_no", "offset", "token_ids", "loss_mask"])

    return ordered(conversations).mapInArrow(run, "conv_id long, turn_no long, offset long, token_ids array<int>, loss_mask array<boolean>")


class Reader:
    """Reads a conversation back from its ids and mask, one turn at a time."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, coder: Codec, ids: list[int], mask: list[bool]) -> None:
        a, b = ids.index(coder.middle), len(ids) - 1
        if ids[0] != coder.start or ids[b] != coder.end:
            raise ValueError("a turn lacks its reserved ids")
        role, text = coder.decode(ids[1:a]), coder.decode(ids[a + 1 : b])
        lost = unescape(coder.decode([i for i, m in zip(ids, mask) if m and i not in coder.reserved]))
        self.turns += 1
        self.chars += len(START) + len(role) + len(MIDDLE) + len(text) + len(END)
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        self.loss.update(lost.encode())
        self.loss_chars += len(lost)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each conversation, from format_turns()'s ids and masks alone."""
    shared = turns.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reader = None, None
        for batch in batches:
            coder, done = coder or Codec(shared.value), []
            for conv, turn, ids, mask in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if turn == 0:
                    done += [reader.row()] if reader else []
                    reader = Reader(conv)
                reader.take(coder, ids, mask)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names)
        if reader:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(reader.row(), kinds)], names)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
