import numpy as np

import corpus_pipeline
from topolark.llm import neardup


def corpus():
    """Near copies at many similarities, short texts, a chain, a common passage and copies of one text."""
    rng = np.random.default_rng(3)
    words = [f"wörd{k}" for k in range(400)]
    passage = " ".join(rng.choice(words, 12))
    texts = [" ".join(rng.choice(words, rng.integers(30, 160))) + (" " + passage if k % 2 else "") for k in range(25)]
    for base in texts[:16]:
        for _ in range(4):
            parts = base.split()
            for at in rng.choice(len(parts), rng.integers(1, 6), replace=False):
                parts[at] = "other"
            texts.append(" ".join(parts))
    parts = texts[20].split()
    for at in range(0, len(parts), 9):
        parts[at] = f"step{at}"
        texts.append(" ".join(parts))
    for k in range(30):
        parts = texts[21].split()
        parts[k % len(parts)] = f"copy{k}"
        texts.append(" ".join(parts))
    return texts + [passage, passage.upper().replace("Ö", "ö"), passage + " tail", texts[0], "", None, " \n", "one two", "ONE  two", "x " * 30, "x " * 50]


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    sets, home = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= 0.8:
                x, y = home[i], home[j]
                home = [min(x, y) if h in (x, y) else h for h in home]
    return home


def test_stage_keeps_one_of_each_class_by_brute_force(spark):
    texts = corpus()
    rows = [(k, t, "n", k) for k, t in enumerate(texts)] + [(3, texts[3], "n", 3), (None, texts[1], "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, root long")
    kept = corpus_pipeline.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    home = brute_classes(texts)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(home))
    assert len(set(home)) < len(texts) - 60


def test_classes_are_those_of_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in neardup.similar_classes(docs).collect()}
    home = brute_classes(texts)
    assert len(root) == len(texts)
    assert len({(root[k], home[k]) for k in root}) == len(set(root.values())) == len(set(home))


def test_empty_table(spark):
    assert neardup.drop_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_texts_at_exactly_the_least_similarity(spark):
    """Pairs whose fingerprints lie far apart although four of five shingles are common."""
    base = "2cc57a f85416 f05f99 465430 c54762 d5a8f0 a2b45f f1b5d2"
    rng = np.random.default_rng(8)
    texts = [base, base + " 4ee34f"]
    for _ in range(400):
        words = [f"{w:06x}" for w in rng.integers(0, 1 << 24, 9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in neardup.similar_classes(docs).collect()}
    assert all(root[k] == root[k + 1] for k in range(0, len(texts), 2))
    assert len(set(root.values())) == len(texts) // 2


def test_sets_beyond_a_sketch(spark, monkeypatch):
    """Sketches that hold a part of a set: links at the least similarity stay, and no others come."""
    monkeypatch.setattr(neardup, "SKETCH", 8)
    rng = np.random.default_rng(9)
    texts = []
    for k in range(12):
        words = [f"w{w}" for w in rng.integers(0, 10**6, 304)]
        texts.append(" ".join(words))
        texts.append(" ".join(words[: 244 - k] + [f"x{w}" for w in rng.integers(0, 10**6, 60 + k)]))
        texts.append(" ".join(words + [f"y{k}x{j}" for j in range(75)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in neardup.similar_classes(docs).collect()}
    home = brute_classes(texts)
    assert len({(root[k], home[k]) for k in root}) == len(set(root.values())) == len(set(home)) == 24


def test_shingle_that_every_text_has(spark):
    texts = [f"the very same five words then a{k} b{k} c{k} d{k} e{k}" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({r.root for r in neardup.similar_classes(docs).collect()}) == 300
