import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from topolark.llm import queries, token_alignment
from topolark.llm.token_alignment import FIGURES, Vocabularies

#: The smallest of the given tables.
SMALL = "/root/testdata/sf0.001"
A, B = queries.BYTE_LEVEL, queries.PIECES


@pytest.fixture(scope="module")
def words():
    return Vocabularies(open(A).read(), open(B, "rb").read())


def whole(words, text):
    """(ids of A, ids of B) of a text encoded at once, with the byte offsets where each ends."""
    a, b = words.a.encode(" " + text, add_special_tokens=False).ids, words.b.encode(text)
    ends = []
    for ids, size in ((a, lambda i: len(words.a_bytes[i])), (b, lambda i: len(words.b_bytes[i]))):
        at, out = 0, []
        for i in ids:
            at += size(i)
            out.append(at)
        ends.append(out)
    return a, b, *ends


def brute(words, rows):
    """The contract by whole texts and comparisons of all token pairs of a document."""
    parsed, counts = [], Counter()
    for doc_id, text in rows:
        a, b, ea, eb = whole(words, text) if text else ([], [], [], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(words.a_bytes[i] for i in a) != raw or b"".join(words.b_bytes[i] for i in b) != raw:
            parsed.append((doc_id, [], [], [], []))
            continue
        sa, sb = [0, *ea], [0, *eb]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]]
        groups, left, right = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            i, j = ea.index(end) + 1, eb.index(end) + 1
            groups.append((a[left:i], b[right:j]))
            left, right = i, j
        counts.update(links)
        parsed.append((doc_id, a, b, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, a, b, groups, links in parsed:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


TEXTS = [
    "The quick brown fox, isn't it?", "The quick brown fox, isn't it?", "", None, "   ", "\n", "a\n\n  b \t c\r\nd ", "x ▁ y", "<s> <|endoftext|> </s> <0x41>", "naïve café é 日本語 テスト 🎉👍🏽", "tabs\tand hard spaces\x1c here \x85.",
    "end with spaces   ", " lead", "1234 567 x1y2", "a\x00b", "don't we'll I'M", " line  par", "ﬁ ½ ①", "foo();\r\n}\r bar", "\t\n x", "x　 y​ z",
]


def test_equals_whole_texts(spark, words):
    rows = list(enumerate(TEXTS)) + [(None, "twice over"), (0, "twice over"), (0, "twice over")]
    docs = spark.createDataFrame([(i, t, 7, 1) for i, t in rows], "doc_id long, text string, block int, n_a int")
    found = token_alignment.align_documents(docs, A, B).select("doc_id", *FIGURES, "groups_sha256").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(brute(words, rows), key=key)


def test_table_of_documents(spark, words):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 1500][:60]
    found = token_alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert sorted(map(tuple, found.collect())) == sorted(brute(words, rows))


def test_segments_of_odd_texts(words):
    """Segment by segment gives the ids of the whole, for every kind of white space beside every kind of sign."""
    signs = ["a", "1", "'s", ".", "é", "日", "🎉", "́", ";", "}", "<"]
    spaces = [" ", "  ", "\n", " \n", "\n ", "\t", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "﻿", "᠎"]
    for left in signs:
        for space in spaces:
            text = "".join(f"{left}{space}{right}" for right in signs) + space
            a, b, *_ = whole(words, text)
            parts = words.segments(text)
            pairs = list(words.encode(parts))
            assert "".join(parts) == " " + text
            assert [i for p, _ in pairs for i in p] == a, (left, space)
            assert [i for _, p in pairs for i in p] == b, (left, space)


def test_vocabulary_has_no_piece_across_a_cut(words):
    pieces = [words.b.id_to_piece(i) for i in range(words.b.get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁") or "\n" in p]
    coder = Tokenizer.from_file(A).pre_tokenizer
    assert [p for p, _ in coder.pre_tokenize_str("ab  cd")] == ["ab", "Ġ", "Ġcd"]


def test_blocks_and_empty(spark, words, monkeypatch):
    rows = [(i, f"alpha beta {i % 3} gamma") for i in range(30)]
    monkeypatch.setattr(token_alignment, "BLOCK", 40)
    monkeypatch.setattr(token_alignment, "PARCEL_ROWS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for most in (0, 1000):  # counts joined, counts looked up
        assert sorted(map(tuple, token_alignment.align_documents(docs, A, B, most).collect())) == sorted(brute(words, rows))
    assert token_alignment.align_documents(docs.limit(0), A, B).count() == 0


@pytest.mark.parametrize("sign", [" ", "\n", "a", "ab "])
def test_very_long(spark, sign):
    text = sign * (400_000 // len(sign))
    row = token_alignment.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    assert row.n_a > 0 and row.n_links >= max(row.n_a, row.n_b)
