import hashlib
import random

import pytest
from pyspark.sql import functions as F

from topolark.llm import merkle
from topolark.llm.merkle import block_height, digest, fold, levels, steps_of, top, traverse


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(top, siblings of each leaf level by level) by building all levels."""
    rows, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(rows) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            paths[k].append((rows[run:i], rows[i + 1 : run + 8]))
        at = [i // 8 for i in at]
        rows = [h(*rows[i : i + 8]) for i in range(0, len(rows), 8)]
    return rows[0], paths


def brute(rows, shown):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(said, (*r[:4], text)))
    by_lang = {}
    for r, text in zip(rows, shown):
        by_lang.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[4]), leaf(r, text), r[0]))
    langs = sorted(by_lang, key=lambda c: (c is not None, (c or "").encode()))
    tops = {c: tree([x[1] for x in sorted(by_lang[c])]) for c in langs}
    root, over = tree([tops[c][0] for c in langs])
    out = []
    for c, upper in zip(langs, over):
        for (_, own, claim, doc_id), path in zip(sorted(by_lang[c]), tops[c][1]):
            folded = claim
            for before, after in path + upper:
                folded = h(*before, folded, *after)
            out.append((doc_id, own, tops[c][0], root, "".join("".join(b + a) for b, a in path + upper), folded, folded == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 512])
def test_traversal_equals_all_levels(n):
    leaves = [h(str(k)) for k in range(n)]
    want, paths = tree(leaves)
    raw, height = [x.encode() for x in leaves], levels(n)
    assert top(raw, height).decode() == want
    for leaf, path, said in zip(raw, traverse(raw, height), paths):
        assert [("".join(b), "".join(a)) for b, a in said] == [(b.decode(), a.decode()) for b, a in steps_of(path)]
        assert fold(leaf, steps_of(path)).decode() == want


def test_last_block_goes_up_all_levels():
    leaf = h("x").encode()
    assert block_height(3, 1) == merkle.HEIGHT and block_height(0, 1) == 0
    assert top([leaf], merkle.HEIGHT) == digest([digest([digest([leaf])])])


def test_state_is_logarithmic():
    trees = merkle.Treehash(2)
    for k in range(512):
        trees.add(h(str(k)).encode())
        assert sum(map(len, trees.stack)) <= 3 * 8


def rows_of(n, rng):
    return [(k if rng.random() < 0.95 else None, rng.choice(["a", None, "ü"]), rng.choice(["en", "en", "en", "de", None, "Z"]), rng.choice([1, None]), rng.choice([None, "", "Text É", f"T{k}"])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 9, 700, 4200])
def test_manifest_equals_brute_force(spark, n):
    rng = random.Random(n)
    rows = rows_of(n, rng) + [(5, "a", "en", 1, "twice")] * 2 + [(5, "a", "en", 1, "other")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string").repartition(5)
    found = merkle.manifest(docs, F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text")))
    shown = [t[4].lower() if t[4] is not None and t[0] is not None and t[0] % 3 == 0 else t[4] for t in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows, shown), key=key)


def test_own_texts_verify_and_empty(spark):
    docs = spark.createDataFrame([(k, "s", "en", 3, f"t{k}") for k in range(20)], "doc_id int, source string, lang string, n_chars int, text string")
    assert {r.verified for r in merkle.manifest(docs).collect()} == {True}
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3, "é" * 3_000_000), (2, None, "en", None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert {r.leaf for r in merkle.manifest(docs).collect()} == {h("1:1", "1:s", "2:en", "1:3", "6000000:" + "é" * 3_000_000), h("1:2", "-", "2:en", "-", "-")}
