import random
import re

import numpy as np
import pytest

import corpus_pipeline
from topolark.llm import decontaminate, quality, queries

SYLLABLES = ["tha", "nor", "wi", "el", "stro", "pa", "ume", "qui", "da", "ber"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, rng):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(5), tmp_path_factory.mktemp("sf")
    items = [(k, prose(24, rng)) for k in range(4)]
    docs = []
    for k in range(240):
        text = prose(rng.randint(20, 140), rng)
        if k % 9 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if k % 13 == 5:
            text += " " + items[k % 4][1]
        if k % 11 == 3:
            text += f" mail me{k}@site.org or call +1 (555) 123-4567"
        docs.append([k, text, "en", f"src{k % 5}" if k % 3 else "hot", len(text)])
    docs += [[300 + k, docs[40][1], "en", "src1", docs[40][4]] for k in range(6)]
    docs += [[400, None, None, None, None], [401, "", "en", None, 0], [402, docs[50][1].replace(".", " end."), "en", "src2", 1]]
    labels = [(k, int(k % 9 != 0), int(k % 7 == 0)) for k in range(0, 240)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, labels, items


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, labels, items):
    """The stages by plain loops: (doc_id, text) that the mix may take, and words by source."""
    from zlib import crc32

    shapes, graded = quality.Shapes(), {k: 0 if q == 0 else 1 if t == 1 else 2 for k, q, t in labels if crc32(str(k).encode()) % 3 != 1}
    seen = sorted((crc32(str(k).encode()), k, graded[k], t) for k, t, *_ in docs if k in graded)
    w, thresholds = quality.fit([quality.features(t.encode(), shapes) for *_, t in seen], [g for *_, g, _ in seen], 3)
    kept = []
    for row in docs:
        at, x = quality.features((row[1] or "").encode(), shapes)
        if 1 / (1 + np.exp(thresholds[0] - w[at] @ x)) >= 0.5:
            kept.append(row)
    sets = [grams(r[1]) for r in kept]
    home = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = home[i], home[j]
                home = [min(a, b) if h in (a, b) else h for h in home]
    kept = [r for i, r in enumerate(kept) if home[i] == i]
    found = []
    for row in kept:
        n, hit = decontaminate.normal(row[1]), False
        for _, item in items:
            m = decontaminate.normal(item).strip()
            k = int(decontaminate.ERROR_RATE * len(m))
            hit |= decontaminate.nearest(decontaminate.Item.of(m), len(m), n, k) is not None
        if not hit:
            found.append(row)
    out = []
    for k, text, _, source, _ in found:
        if text:
            text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
            text = re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "[PHONE]", text)
        out.append((k, text, source))
    return out


def test_run_matches_brute_force(spark, tables):
    folder, docs, labels, items = tables
    expected = brute(docs, labels, items)
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    texts = {k: t for k, t, _ in expected}
    assert {r.doc_id for r in rows} <= texts.keys() and all(r.text == texts[r.doc_id] for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows if r.text and "[EMAIL]" in r.text)
    sizes = {}
    for _, text, source in expected:
        sizes[source] = sizes.get(source, 0) + len(WORDS.findall(text or ""))
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and 0 < r.times <= 3 and r.taken == r.times * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - t) <= max(5, 0.05 * t) for s, t in targets.items())
    assert len(expected) < len(docs) - 25


def test_stages_return_the_columns_of_documents(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_queries_run_over_whole_tables(spark, tables):
    folder, docs, *_ = tables
    for name in ("op1_licenses", "op2_simhash", "op3_mixing", "op4_toxicity", "op8_pii", "op10_quality"):
        out = queries.queries()[name](spark, folder)
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(d[0] for d in docs), name
