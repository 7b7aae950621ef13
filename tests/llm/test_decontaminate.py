import random

import pytest

from topolark.llm import decontaminate as dc

SYLLABLES = ["tha", "nor", "wi", "el", "stro", "pa", "ume", "qui", "da", "ber"]


def prose(n, rng):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def edit(text, n, rng):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(at, "z"), lambda: out.pop(at), lambda: out.insert(at, "q")])()
    return "".join(out)


def least_distance(pattern, text):
    """Edit distance of the nearest substring, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance_matches_the_table():
    rng = random.Random(1)
    for _ in range(60):
        pattern, text = prose(4, rng), prose(8, rng)
        if rng.random() < 0.5:
            text = text[:10] + edit(pattern, 2, rng) + text[10:]
        expected = least_distance(pattern, text)
        found = dc.nearest(dc.Item.of(pattern), len(pattern), text, len(pattern))
        assert found[0] == expected
        assert least_distance(pattern, text[: found[1]]) == expected


def test_no_occurrence_within_the_budget_is_missed(spark):
    rng = random.Random(2)
    items = [(k, prose(25, rng)) for k in range(8)] + [(8, "Short one"), (9, None), (10, ""), (11, "!!!"), (12, None)]
    items.append((20, items[0][1].upper()))
    docs = []
    for k in range(60):
        text = prose(120, rng)
        if k % 3 == 0:
            item = items[k % 8][1]
            text = text[:200] + " " + edit(item, rng.randint(0, int(dc.ERROR_RATE * len(item)) + 4), rng) + " " + text[200:]
        docs.append((k, text, "x"))
    docs += [(100, None, ""), (101, "", ""), (102, "a short ONE, here", ""), (103, "shortone ashort one2", ""), (None, items[1][1], ""), (104, prose(20000, rng) + " " + items[2][1], "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    found = {}
    for blocks in (1 << 20, 700):
        found[blocks] = {(r.doc_id, r.item_id, r.distance) for r in dc.contaminations(df, bench, block_bytes=blocks).collect()}
        kept = dc.decontaminate(df, bench, block_bytes=blocks)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(d[0]) for d in docs} - {str(d) for d, *_ in found[blocks]})
    assert found[700] == found[1 << 20]
    expected = set()
    for d, text, _ in docs[:60]:
        n = dc.normal(text)
        for i, item in items:
            m = dc.normal(item).strip()
            if len(m) > 30 and (distance := least_distance(m, n)) <= int(dc.ERROR_RATE * len(m)):
                expected.add((d, i, distance))
    assert {f for f in found[700] if f[0] is not None and f[0] < 60} == expected and len(expected) > 10
    rest = {(d, i) for d, i, _ in found[700] if d is None or d >= 100}
    assert rest == {(102, 8), (None, 1), (104, 2)}


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    rng = random.Random(3)
    item = prose(25, rng)
    df = spark.createDataFrame([(1, prose(50, rng), 7), (2, f"x {item} y", 8), (3, None, 9)], "doc_id long, text string, hits long")
    out = dc.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == df.columns and sorted((r.doc_id, r.hits) for r in out.collect()) == [(1, 7), (3, 9)]


def test_each_block_has_a_pass_of_its_own(spark):
    items = [(k, f"item number {k} with some text of its own to find") for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(k, text) for k, text in items] + [(9, "clean")], "doc_id long, text string")
    for out in (dc.contaminations(df, bench, block_bytes=100), dc.decontaminate(df, bench, block_bytes=100)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminations(df, bench, error_rate=0.0, block_bytes=100).collect()) == [(k, k) for k in range(6)]
    assert [r.doc_id for r in dc.decontaminate(df, bench, block_bytes=100).collect()] == [9]


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    df = spark.createDataFrame([] if empty == "docs" else [(1, "text")], "doc_id long, text string")
    items = spark.createDataFrame([] if empty == "items" else [(1, "some longer item text")], "item_id long, text string")
    assert dc.contaminations(df, items).count() == 0
