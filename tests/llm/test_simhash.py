import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from topolark.llm import simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows):
    """doc_id -> smallest reachable id, by comparing all pairs."""
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                home[root(i)] = root(j)
    return {i: min((rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None), default=None) for i in range(len(rows))}


def corpus():
    rng = np.random.default_rng(1)
    words = [f"wörd{k}" for k in range(300)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    texts = list(base)
    for k, b in enumerate(base[:6]):
        parts = b.split()
        for n in range(4):
            changed = list(parts)
            changed[n * 7] = "other"
            texts.append("\t".join(changed) if n % 2 else " ".join(changed).upper().replace("Ö", "ö"))
    texts += [base[0], base[0], "", None, " \n\t", "one two", "ONE  two", "a b c d", "x" * 200_000, "w " * 60_000]
    return texts


def test_fingerprints_and_classes_match_brute_force(spark):
    texts = corpus()
    rows = [(k if k % 11 else k, t, "extra") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    found = {r.doc_id: r for r in simhash.near_duplicate_classes(docs).select("doc_id", simhash.fingerprint_hex("fp").alias("h"), "component_id").collect()}
    expected = [(k, brute(t)) for k, t, _ in rows]
    home = classes(expected)
    assert len(found) == len(rows)
    for k, fp in expected:
        assert found[k].h == f"{fp:016x}"
        assert found[k].component_id == home[k]


def test_links_are_complete_for_both_segment_plans(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for n in range(1, 7):
            mask = sum(1 << int(k) for k in rng.choice(64, n, replace=False))
            fps.add(int(b) ^ mask)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for segments in (2, 3, 5):
        plan = simhash.segment_plan(4, segments)
        assert sum(r + 1 for *_, r in plan) >= 5 and sum(w for _, w, _ in plan) == 64
        assert {tuple(r) for r in simhash.hamming_links(df, 4, segments).collect()} == expected


def test_components_of_chains_stars_and_rings(spark):
    from topolark.llm.common import Scratch

    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (200, 202)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in simhash.components(df, Scratch(spark)).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {201: 200, 202: 200}


def test_drop_keeps_one_of_each_class_and_all_columns(spark):
    texts = corpus()
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(3, texts[3], 3), (3, texts[3], 3), (None, "only without id", 0), (None, texts[1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_hash long")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    home = classes([(k, brute(t)) for k, t, _ in rows])
    alone = {home[i] for i in range(len(rows)) if home[i] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(alone)
    assert ids.count(None) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_classes(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_spark_hash_is_the_contract_hash(spark):
    texts = ["", "abc", "héllo wörld " * 9, "€" * 33]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r.h & (2**64 - 1) == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in rows)
