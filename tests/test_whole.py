"""Queries do their whole job, and in forms that grow with their tables."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from topolark.functions import staging
from topolark.operators import route
from topolark.plans.derived import duckdb_sql
from topolark.plans.topology import derive, derive_staged, links_at, links_of_kept, with_link_columns
from topolark.sources import project

from fixtures import base, make

FOLDER = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return c


@needs_tables
def test_hops_meet_the_walls_of_all_drawings(spark, db):
    """a hop's walls are all walls, not those dealt to its floor."""
    floors = dict(db.sql(duckdb_sql("select e.idx, n.floor_id from edges e join nodes n on n.id = e.from_node_id")).fetchall())
    met = driver.queries()["join6"](spark, FOLDER).collect()
    assert any(floors[r.hop_id] != f"F{r.wall_id % 25}" for r in met)
    crossing = {r.hop_id for r in driver.queries()["srt2"](spark, FOLDER).where("crosses").collect()}
    assert crossing == {r.hop_id for r in met}


@needs_tables
def test_derived_links_are_not_written(spark):
    """F4 to F16: links are pairs of points and nodes, many more than both; filters meet the ends first."""
    t, plain = derive_staged(spark, FOLDER), derive(spark, FOLDER).links
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "access_point_id", "node_id", "cost", "idx").collect())
    assert not hasattr(t.links, "_staged") and rows(t.links) == rows(plain)
    some = t.access_points.where("idx % 2 = 1").select("place_id", F.col("id").alias("own"))
    assert rows(links_at(t, some, "own")) == rows(plain.join(some, F.col("access_point_id") == F.col("own")))
    gone = lambda df, c: df.where(F.substring(c, -1, 1) != "3")
    assert rows(links_of_kept(t, gone, gone)) == rows(gone(gone(plain, "access_point_id"), "node_id"))
    told = with_link_columns(t, {"said": F.concat(F.lit("by "), "id")})
    assert {r.said for r in links_at(told, some, "own").collect()} == {f"by {r[0]}" for r in rows(links_at(t, some, "own"))}


def test_sums_before_each_row(spark, tmp_path):
    rows = [(k, k % 4) for k in range(200)]
    found = staging.summed(spark.createDataFrame(rows, "idx long, many long").repartition(5), ["idx"], "many", staging.Staging(spark), "first").collect()
    assert {r.idx: r["first"] for r in found} == {k: sum(m for _, m in rows[:k]) for k, _ in rows}


@needs_tables
def test_searches_take_a_row_for_each_stop(spark):
    """F8 to F16: pairs of stops go through hubs, which get no label."""
    t = derive_staged(spark, FOLDER)
    seeds = route.endpoint_options(t, wanted=spark.createDataFrame([("P4",)], "place_id string")).select(F.col("place_id").alias("source"), "node_id", "cost")
    labels = lambda hops: {(r.node_id, r.cost, r.n) for r in route.labels(seeds, hops, 1000).collect()}
    assert labels(route.compact_hops(t)) == labels(route.hops(t))


@needs_tables
def test_documents_in_parts_hold_no_array_in_a_row(spark, tmp_path, monkeypatch):
    """A project is written and read in lines: together they are the document that one row would have been, and snk3 needs no such row."""
    rows = base(nodes=[(f"n{k}", "f4", "turn", float(k), 0.0) for k in range(700)], links=[(f"l{k}", "door", f"n{k}", 1.0, 'Say "hi",\n{', None) for k in range(700)])
    t = make(spark, **rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    project.write_parts(t, "m", "Map", "2024-01-01T00:00:00Z", str(tmp_path / "in"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(tmp_path.glob("in/section_=*/part-*"), key=lambda f: (int(f.parent.name.split("=")[1]), f.name))
    assert len(files) > 11
    found = json.loads("".join(f.read_text() for f in files))
    wanted = json.loads(project.join(t, "m", "Map", "2024-01-01T00:00:00Z").select(F.to_json(F.struct("*"))).first()[0])
    assert found == wanted and len(found["topology"]["nodes"]) == 702
    back, head = project.read_parts(spark, str(tmp_path / "in"))
    assert head == {"id": "m", "name": "Map", "updatedAt": "2024-01-01T00:00:00Z"}
    (tmp_path / "whole.json").write_text(json.dumps(wanted))
    whole = project.split(project.read_project(spark, str(tmp_path / "whole.json")))
    for name, given in vars(whole).items():
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, given.collect())), name

    def no_row(*_):
        raise AssertionError("an array in one row")

    monkeypatch.setattr(project, "_list", no_row)
    assert len(driver.queries()["snk3"](spark, FOLDER).collect()) >= 0
    monkeypatch.undo()
    head_file = next(tmp_path.glob("in/section_=0/part-*"))
    (tmp_path / "bad" / "section_=0").mkdir(parents=True)
    (tmp_path / "bad" / "section_=0" / "part-0.txt").write_text(head_file.read_text().replace('"documentVersion": 1', '"documentVersion": 2'))
    with pytest.raises(ValueError):
        project.repair_file(spark, str(tmp_path / "bad"), str(tmp_path / "out"))
