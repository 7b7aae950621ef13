import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from topolark.llm import queries, token_files
from topolark.llm.token_files import BLOCK, Encoder, pack, read_ids, unpack, write_ids

#: The smallest of the given tables.
SMALL = "/root/testdata/sf0.001"
FILE, END = queries.WORDS, queries.END_ID


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(FILE)


def block(data):
    n, length = token_files.struct.unpack_from(BLOCK, data)
    head = token_files.struct.calcsize(BLOCK)
    control = -(-n // 4)
    assert len(data) == head + control + length
    return unpack(n, data[head : head + control], data[head + control :])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]))))
def test_coding_round_trip(values):
    assert block(pack(np.array(values, np.uint32))).tolist() == values


def test_bytes_of_values():
    assert pack(np.array([1, 256, 65536, 2**24], np.uint32))[8:] == bytes([0b11100100, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1])


def brute(coder, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


TEXTS = [
    "Hello, World. It's A.B.C. and don't.", "", None, "   \n\t ", "<|endoftext|> x<|startoftext|>y. <|EndOfText|>", "naïve CAFÉ é. İstanbul ΣΑΣ Σ.", "日本語。テスト 🎉 12.5 1,000 a1.b2", "x y z\x85w\x1c.", "a.́ b,́c", "'s. 'll, we'll. I'M.", "́x ́", "ﬁ ½ ①.", "UPPER.lower,Mixed", "a\x00b.", "Żółć, ŒUVRE. İ. ŉ, ſ. Ǆ. é, e\u0301, ÀÉ. ß,ẞ.",
]


def test_words_apart_equal_whole_texts(coder):
    import pyarrow as pa

    ids, ends = Encoder(open(FILE).read()).encode(pa.chunked_array([pa.array(TEXTS[:5], pa.string()), pa.array(TEXTS[5:], pa.string())]))
    start = 0
    for text, end in zip(TEXTS, ends.tolist()):
        assert ids[start:end].tolist() == coder.encode(text or "", add_special_tokens=False).ids, text
        start = end


def test_equals_brute_force(spark, coder, monkeypatch):
    monkeypatch.setattr(token_files, "VALUES", 16)  # blocks that end inside documents
    rows = [(3 * k, t) for k, t in enumerate(TEXTS)] + [(1, "word " * 100)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, ids int, shard int").repartition(4)
    manifest, folder = write_ids(docs, FILE, END)
    found = read_ids(manifest, folder)
    assert sorted(map(tuple, found.collect())) == sorted(brute(coder, sorted(rows, key=lambda r: r[0])))


def test_null_and_repeated_ids(spark, coder):
    rows = [(None, "n"), (4, "same"), (4, "same"), (4, "another"), (2, "b")]
    found = sorted(map(tuple, read_ids(*write_ids(spark.createDataFrame(rows, "doc_id long, text string"), FILE, END)).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, 2, 4, 4, 4]
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in brute(coder, rows))
    assert [r[1] for r in found] == np.cumsum([0, *[r[2] for r in found[:-1]]]).tolist()
    assert [r[3] for r in found if r[0] == 4] == sorted(r[3] for r in found if r[0] == 4)


def test_rank_zero_is_the_most_frequent_id(spark, coder):
    manifest, folder = write_ids(spark.createDataFrame([(1, "the the the of of cat")], "doc_id long, text string"), FILE, END)
    system, path = token_files.store(folder)
    with system.open_input_stream(f"{path}/codebook.bin") as source:
        order = np.frombuffer(source.read(), "<u4").tolist()
    assert order[:2] == coder.encode("the of", add_special_tokens=False).ids
    assert manifest.count() == 1


def test_documents_table(spark, coder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, read_ids(*write_ids(docs, FILE, END)).collect())) == sorted(brute(coder, rows))


def test_empty_table(spark):
    assert read_ids(*write_ids(spark.createDataFrame([], "doc_id long, text string"), FILE, END)).count() == 0


@pytest.mark.parametrize("sign", [" ", "\n", "a", "1 ", "é"])
def test_very_long(spark, coder, sign):
    text = sign * (300_000 // len(sign))
    assert tuple(read_ids(*write_ids(spark.createDataFrame([(1, text)], "doc_id long, text string"), FILE, END)).first()) == brute(coder, [(1, text)])[0]


def test_words_in_whatever_case_are_merged_once(coder):
    """The model is asked once for a word in several cases; lowering is that of the normalizer for all letters that count as plain."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    class Counted:
        def __init__(self, model):
            self.model, self.asked = model, []
            self.tokenize = lambda word: (self.asked.append(word), model.tokenize(word))[1]

    encoder = Encoder(open(FILE).read())
    model, whole = Counted(encoder.coder.model), encoder.coder
    encoder.coder = type("Coder", (), {"model": model, "encode_batch_fast": whole.encode_batch_fast})()
    text = "Table TABLE table Tablé. TABLÉ a1 A1"
    ids, _ = encoder.encode(pa.chunked_array([pa.array([text])]))
    assert ids.tolist() == coder.encode(text, add_special_tokens=False).ids and len(model.asked) == 2
    letters = re.findall(f"[{token_files.LETTERS}]", "".join(map(chr, range(0x250))))
    assert pc.utf8_lower(pa.array(letters)).to_pylist() == [c.lower() for c in letters]
    every = " ".join(letters)
    assert encoder.encode(pa.chunked_array([pa.array([every])]))[0].tolist() == coder.encode(every, add_special_tokens=False).ids
