"""Queries on tables whose keys or groups are larger than those of the small copies."""

import math
import re
import time

import pytest
from pyspark.sql import functions as F

from kartospark.operators import areas, classify, course, graph, rings, routing, stencil
from kartospark.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def _far_suppliers(spark, tmp_path):
    """Lines of suppliers beyond 60000, each with all seven symbols."""
    spark.range(60000, 60100).selectExpr("id l_suppkey", "explode(sequence(1, 7)) l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_courses_by_labels_of_large_supplier_keys(spark, tmp_path):
    assert QUERIES["courses_by_labels"](spark, _far_suppliers(spark, tmp_path)).count() > 0


def test_courses_by_lines_of_large_supplier_keys(spark, tmp_path):
    assert QUERIES["courses_by_lines"](spark, _far_suppliers(spark, tmp_path)).count() > 0


def test_boxes_are_matched_as_their_candidate_pairs_are(spark):
    """Many boxes and circles of one place, and more than a tile across: the same as by pairs."""
    spots = spark.range(1200).selectExpr("id % 2 map_id", "id node", "double(hash(id, 1) % 60) + 60 cx", "double(hash(id, 2) % 12) cy")
    boxes = spots.selectExpr("map_id", "node lid", "cx + 3 x0", "cy - 2 y0", "cx + 9 x1", "cy + 2 y1")
    want = course.matched(course.label_candidates(boxes, spots, F.lit(1.0)))
    got = course.matched_boxes(boxes, spots, F.lit(1.0))
    assert sorted(map(tuple, got.select("map_id", "lid", "node").collect())) == sorted(map(tuple, want.select("map_id", "lid", "node").collect()))


def test_circles_of_one_place_are_suppressed_without_pairs_of_them(spark):
    """Thirty thousand circles of four places: all pairs would be hundreds of millions; one that reaches nothing stays."""
    circles = spark.range(30000).selectExpr("0 map_id", "id cid", "double(id % 4 * 5) cx", "0.0D cy", "3.0D cr", "double(id % 4 + id % 7) support")
    alone = spark.createDataFrame([(0, 90000, 5.0, 0.0, 0.0, 0.0)], circles.schema)
    start = time.monotonic()
    kept = rings.suppressed(circles.union(alone), F.when(F.col("cr") > 0, 8.0).otherwise(0.0)).collect()
    assert sorted((c.cx, c.cid) for c in kept) == [(5.0, 13), (5.0, 90000), (15.0, 27)]
    assert time.monotonic() - start < 60


def test_hatch_elements_are_not_sent_to_the_driver_map_by_map(spark, monkeypatch):
    """Openings by sizes of their own: equal to those map by map, and nothing that grows with the maps is broadcast by name."""
    pixels = spark.range(6 * 400).selectExpr("id div 400 map_id", "int(id % 400 div 20) y", "int(id % 20) x").where("hash(y, x, map_id) % 9 <> 0")
    sizes = spark.createDataFrame([(m, 3 + m % 3 * 2) for m in range(6)], "map_id long, k int")
    sent = []
    broadcast = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append(df.count()), broadcast(df))[1])
    got = {tuple(r) for r in areas._opened_each(pixels, sizes).collect()}
    assert sum(sent) <= 3
    want = set()
    for m in range(6):
        own, k = {(r.y, r.x) for r in pixels.where(f"map_id = {m}").collect()}, stencil.ellipse(3 + m % 3 * 2)
        left = {(y, x) for y, x in own if all((y + a, x + b) in own for a, b in k)}
        want |= {(m, y + a, x + b) for y, x in left for a, b in k}
    assert got == want


def test_legs_from_one_cell_spread_once(spark):
    """Two hundred controls on two cells: distances of two starts only, and each leg its route."""
    cells = spark.range(64).selectExpr("0 map_id", "int(id div 8) r", "int(id % 8) c", "1.0D cost")
    at = spark.range(200).selectExpr("0 map_id", "id pid", "int(id % 2 * 7) r", "int(id % 2 * 7) c")
    controls = at.selectExpr("map_id", "pid id", "pid order", "c * 4.0D x", "r * 4.0D y")
    rows = []
    spread = routing.spread
    with pytest.MonkeyPatch.context() as m:
        m.setattr(routing, "spread", lambda *a, **k: (lambda d: (rows.append(d.count()), d)[1])(spread(*a, **k)))
        legs = routing.legs(controls, cells, at, 4).collect()
    assert rows[0] <= 2 * 64
    assert len(legs) == 199 and all(g.ok and abs(g.cost - 28 * 2**0.5) < 1e-9 and len(g.path) == 2 for g in legs)


def test_cost_ramp_does_not_hang_on_the_last_bits_of_means(spark):
    """Two cells of the same pixels, whose mean was summed in different orders, have one colour; so have both ends of a flat map."""
    up = 1.5 + 2**-52
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 1.5), (0, 0, 2, up), (1, 0, 0, 1.5), (1, 0, 1, up)], "map_id int, row int, c int, cost double")
    shown = {(r.map_id, r.c): (r.r, r.g) for r in classify.cost_ramp(cells).collect()}
    assert shown == {(0, 0): (0, 255), (0, 1): (255, 0), (0, 2): (255, 0), (1, 0): (0, 255), (1, 1): (0, 255)}


def _sampled_rows(monkeypatch):
    """Numbers of circles that ``ring_support`` is asked for, call by call."""
    rows, support = [], rings.ring_support
    monkeypatch.setattr(rings, "ring_support", lambda circles, *a, **k: (rows.append(circles.count()), support(circles, *a, **k))[1])
    return rows


def _equal_circles(spark):
    mask = spark.range(900).selectExpr("0 map_id", "int(id div 30) y", "int(id % 30) x").where("abs(sqrt(pow(y - 15, 2) + pow(x - 15, 2)) - 8) < 1")
    return spark.range(300).selectExpr("0 map_id", "id cid", "double(14 + id % 3) cx", "15.0D cy", "8.0D cr"), mask


def test_equal_circles_are_polished_once(spark, monkeypatch):
    circles, mask = _equal_circles(spark)
    rows = _sampled_rows(monkeypatch)
    got = rings.polished(circles, mask).collect()
    assert rows == [3 * 175] and len(got) == 300
    assert len({(r.cid % 3, r.cx, r.cy, r.cr, r.support) for r in got}) == 3


def test_centres_of_one_place_are_sampled_once(spark, monkeypatch):
    circles, mask = _equal_circles(spark)
    rows = _sampled_rows(monkeypatch)
    got = rings.radial_profile(circles, mask, F.array(F.lit(7.0), F.lit(8.0), F.lit(8.5))).collect()
    assert rows == [3 * 3] and len(got) == 900
    assert all(r.support == 1.0 for r in got if r.cid % 3 == 1 and r.radius == 8.0)


def _brute_components(pixels, diagonal):
    left, out = set(pixels), {}
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not a or not b} & left
            left -= near
            todo += near
        out |= dict.fromkeys(part, min(part))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_equal_brute_force_and_only_what_crosses_bands_is_a_graph(spark, monkeypatch, diagonal):
    """Maps of several bands, with components through all of them, rows left out and columns below zero."""
    edges, connected = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e: (edges.append(e.count()), connected(e))[1])
    plane = spark.range(2 * 200 * 40).selectExpr("id % 2 map_id", "int(id div 80) y", "int(id div 2 % 40) - 20 x")
    mask = plane.where("abs(hash(map_id, y, x)) % 100 < 38 + 10 * map_id and y % 150 <> 140 or x = 3 and map_id = 1")
    got = graph.mask_components(mask, diagonal).collect()
    for m in range(2):
        own = [r for r in got if r.map_id == m]
        assert {(r.y, r.x): (r.comp.y, r.comp.x) for r in own} == _brute_components([(r.y, r.x) for r in own], diagonal)
    assert len(got) == mask.count()
    assert edges[0] < 200 * 2


@pytest.mark.parametrize("k", [2, 3, 4, 5, 8, 9])
def test_openings_equal_brute_force(spark, k):
    """Even sizes too, whose elements are not symmetric; pixels beyond the border do not count."""
    rows = spark.range(2 * 24 * 20).selectExpr("id % 2 map_id", "int(id div 40) y", "int(id div 2 % 20) x").selectExpr("*", "abs(hash(map_id, y, x)) % 100 < 85 + 10 * map_id on")
    got = {(r.map_id, r.y, r.x) for r in stencil.opened_by(rows, "on", k, "out").where("out").collect()}
    own, element = {(r.map_id, r.y, r.x) for r in rows.where("on").collect()}, stencil.ellipse(k)
    plane = {(m, y, x) for m in range(2) for y in range(24) for x in range(20)}
    left = {(m, y, x) for m, y, x in own if all((m, y + a, x + b) in own or (m, y + a, x + b) not in plane for a, b in element)}
    assert got == {(m, y + a, x + b) for m, y, x in left for a, b in element} & plane and got


def test_pixels_are_not_broadcast(spark, monkeypatch):
    """Pixels are small on disk: by the sizes of files, they and what is spread of them would go through the driver.

    Only elements by size, sizes of maps and the last rows of bands do, whose estimate is that of all rows.
    """
    plans, written = [], areas.written

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    plane = spark.range(2 * 40 * 40).selectExpr("id % 2 map_id", "int(id div 80) y", "int(id div 2 % 40) x")
    plane = written(plane.selectExpr("*", "abs(hash(map_id, y, x)) % 11 label", "abs(hash(x, y)) % 3 = 0 purple"))
    for module in (areas, graph):
        monkeypatch.setattr(module, "written", lambda df: written(plan(df)))
    plan(areas.outside_map(areas.hatched(plane, 2.0), 1.0))
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert len(plans) > 10 and [line for line in joins if not re.search(r"\], \[(k|em|m)#", line)] == []


@pytest.mark.parametrize("bands", [1, 2])
def test_components_equal_brute_force_across_groups_of_bands(spark, monkeypatch, bands):
    """Links within groups of bands are settled in tasks, those between groups as a graph."""
    monkeypatch.setattr(graph, "BANDS", bands)
    mask = spark.range(330 * 24).selectExpr("0 map_id", "int(id div 24) - 10 y", "int(id % 24) x").where("abs(hash(y, x)) % 100 < 45")
    got = {(r.y, r.x): (r.comp.y, r.comp.x) for r in graph.mask_components(mask).collect()}
    assert got == _brute_components(got, True)


@pytest.mark.parametrize(("bands", "links"), [(64, 0), (5, 5)])
def test_only_links_between_groups_of_bands_are_a_graph(spark, monkeypatch, bands, links):
    """A snake through ten bands of a map, up and down."""
    monkeypatch.setattr(graph, "BANDS", bands)
    edges, connected = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e: (edges.extend(e.collect()), connected(e))[1])
    snake = spark.range(640 * 9).selectExpr("0 map_id", "int(id div 9) y", "int(id % 9) x").where("x % 2 = 0 or x % 4 = 1 and y = 639 or x % 4 = 3 and y = 0")
    assert {tuple(r.comp) for r in graph.mask_components(snake).collect()} == {(0, 0)}
    assert len(edges) == links


def test_ring_support_equals_its_samples(spark):
    """Centres and radii across cells, beyond the border and between pixels; tolerances of their own."""
    mask = spark.range(130 * 90).selectExpr("id % 2 map_id", "int(id div 180) y", "int(id div 2 % 90) x").where("abs(hash(map_id, y, x)) % 10 < 3")
    circles = spark.range(160).selectExpr("id % 3 map_id", "named_struct('a', id, 'b', 'c') cid", "(hash(id, 1) % 110) / 2 + 20 cx", "(hash(id, 2) % 90) / 4 + 15.0D cy", "abs(hash(id, 3) % 80) / 2 + 1 cr")
    circles = circles.union(circles.where("cid.a < 5").selectExpr("map_id", "named_struct('a', cid.a + 500, 'b', 'c')", "cx", "cy", "cr"))
    tol = F.when(F.col("cr") < 9, 1.0).otherwise(0.1 * F.col("cr"))
    there = {(r.map_id, r.y, r.x) for r in mask.collect()}
    got = {r.cid.a: (r.map_id, r.support, r.coverage) for r in rings.ring_support(circles, mask, tol, n=36).collect()}
    for c in circles.withColumn("tol", tol).collect():
        offsets = [i * 0.5 - c.tol for i in range(math.floor(c.tol * 4 + 0.02) + 1)]
        turns = [k * (2 * math.pi / 36) for k in range(36)]
        hit = [any((c.map_id, round(c.cy + (c.cr + o) * math.sin(t)), round(c.cx + (c.cr + o) * math.cos(t))) in there for o in offsets) for t in turns]
        sectors = [hit[k : k + 4] for k in range(0, 36, 4)]
        assert got.pop(c.cid.a) == (c.map_id, sum(hit) / 36, sum(sum(s) >= 1 for s in sectors) / 9)
    assert not got


def test_tries_of_circles_are_not_broadcast(spark):
    """Thousands of tries come of one row: the plan would take them for few and send them through the driver."""
    circles, mask = _equal_circles(spark)
    got = rings.polished(circles, mask)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 300
