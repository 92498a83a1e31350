from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kartospark.plans import analysis, stages
from kartospark.settings import Settings
from test_plans import pixels, small_map

CFG = Settings(outside_map_enabled=False, hatch_enabled=False)


@pytest.fixture
def calls(monkeypatch):
    made = []
    for name in ("segmented", "terrain_planes", "cost_grid"):

        def counted(rows, *args, f=getattr(analysis, name), name=name, **kwargs):
            made.append((name, sorted(r[0] for r in rows.select("map_id").distinct().collect())))
            return f(rows, *args, **kwargs)

        monkeypatch.setattr(analysis, name, counted)
    return made


def test_only_what_changed_is_made_again(spark, tmp_path, calls):
    """Nothing at a second call; the grid alone for another cost or edit; one map for one map's change; all of a new map."""
    store = stages.Store(spark, str(tmp_path))
    one, two = (pixels(spark, small_map()[:20, :24], m) for m in ("a", "b"))
    both = one.union(two).persist()

    def run(maps=both, **kwargs):
        calls.clear()
        planes, cells = stages.analysed(store, maps, 4.0, **({"cfg": CFG} | kwargs))
        return sorted(map(tuple, planes.select("map_id", "y", "x", "label", "forbidden").collect())), sorted(map(tuple, cells.collect())), list(calls)

    first = run()
    assert [c for c, _ in first[2]] == ["segmented", "terrain_planes", "cost_grid"] and {tuple(m) for _, m in first[2]} == {("a", "b")}
    planes = analysis.terrain_planes(labels := analysis.segmented(both, CFG), 4.0, CFG, labels)
    assert first[0] == sorted(map(tuple, planes.select("map_id", "y", "x", "label", "forbidden").collect()))
    again = run()
    assert again == (first[0], first[1], [])
    dear = run(cfg=replace(CFG, cost_beige=2.0))
    assert dear[2] == [("cost_grid", ["a", "b"])] and dear[0] == first[0] and dear[1] != first[1]
    wall = spark.createDataFrame([("b", "w", "forbid", [(2.0, 2.0), (9.0, 2.0), (9.0, 9.0)])], "map_id string, edit_id string, kind string, points array<struct<x:double,y:double>>")
    edited = run(edits=wall)
    assert edited[2] == [("cost_grid", ["b"])] and [c for c in edited[1] if c[0] == "a"] == [c for c in first[1] if c[0] == "a"] and edited[1] != first[1]
    darker = run(one.withColumn("r", F.when((F.col("y") == 3) & (F.col("x") == 3), 0).otherwise(F.col("r"))).union(two))
    assert {tuple(m) for _, m in darker[2]} == {("a",)} and len(darker[2]) == 3
    assert run()[2] == []
    both.unpersist()


def test_a_failed_stage_leaves_nothing(spark, tmp_path):
    store = stages.Store(spark, str(tmp_path))
    keys = spark.createDataFrame([("a", "k")], "map_id string, key string")

    def fails(maps):
        return maps.select("map_id", F.raise_error("no").cast("int").alias("v"))

    with pytest.raises(Exception, match="no"):
        store.result("s", keys, fails)
    assert store.result("s", keys, lambda maps: maps.select("map_id", F.lit(3).alias("v"))).first().v == 3
    assert store.result("s", keys, fails).first().v == 3


def test_no_maps_give_no_rows(spark, tmp_path):
    keys = spark.createDataFrame([], "map_id string, key string")
    assert stages.Store(spark, str(tmp_path)).result("s", keys, lambda maps: maps.select("map_id", F.lit(3).alias("v"))).count() == 0
