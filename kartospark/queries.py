"""One query for each relational operator, over rasters, points and texts made of the driver's tables, with its SQL.

The rasters are ``embeddings`` unnested, ``HEIGHT`` vectors a map: row and map by
``vec_id``, column the position, value the component in thousandths. Masks and labels are
remainders of the value. Points, one a user, lie on the first two maps.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kartospark.functions import color
from kartospark.operators import areas, classify, course, graph, lines, nearest, rings, routing, stencil, terrain
from kartospark.plans import analysis, stages
from kartospark.settings import CLASS_NAMES, DISPLAY_COLORS, REFERENCE_COLORS, Settings, terrain_class
from kartospark.sources import images, projects
from kartospark.sources.shared import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
INF = float("inf")

#: Vectors of one map.
HEIGHT = 250

_RASTER = f"""
    with r as (select (vec_id // {HEIGHT})::int map_id, (vec_id % {HEIGHT})::int y, (i - 1)::int x, floor(embedding[i]::double * 1000)::bigint v
               from (select *, unnest(range(1, len(embedding) + 1)) i from embeddings)),
    m as (select *, ((v % 11) + 11) % 11 label, v % 2 = 0 m2, v % 3 = 0 m3, v % 4 = 0 m4 from r)"""
_COLORS = f"""{_RASTER},
    c as (select a.map_id, a.y, a.x, ((a.v % 256) + 256) % 256 r, ((b.v % 256) + 256) % 256 g, ((d.v % 256) + 256) % 256 b
          from r a join r b on a.map_id = b.map_id and a.y = b.y and b.x = a.x + 1 join r d on a.map_id = d.map_id and a.y = d.y and d.x = a.x + 2)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place() -> tuple[Column, Column]:
    return F.floor(F.col("vec_id") / HEIGHT).cast("int").alias("map_id"), (F.col("vec_id") % HEIGHT).cast("int").alias("y")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _table(spark, sf_dir, "embeddings").select(*_place(), F.posexplode("embedding").alias("x", "e"))
    v = cells.select("map_id", "y", "x", F.floor(F.col("e").cast("double") * 1000).cast("long").alias("v"))
    return v.withColumns({"label": F.pmod("v", F.lit(11)).cast("int"), "m2": F.col("v") % 2 == 0, "m3": F.col("v") % 3 == 0, "m4": F.col("v") % 4 == 0})


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = _table(spark, sf_dir, "embeddings").withColumn("c", F.transform("embedding", lambda e: F.pmod(F.floor(e.cast("double") * 1000), F.lit(256)).cast("int")))
    at = comps.select(*_place(), "c", F.explode(F.sequence(F.lit(0), F.size("c") - 3)).alias("x"))
    return at.select("map_id", "y", "x", *[F.get("c", F.col("x") + i).alias(n) for i, n in enumerate("rgb")])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a user: the largest value across, the number of events down."""
    found = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.max("value") / 8).alias("a"), F.count(F.lit(1)).alias("n"), F.max("event_id").alias("e"))
    return found.select((F.col("user_id") % 2).cast("int").alias("map_id"), F.col("user_id").alias("pid"), (F.col("a") % 64).cast("double").alias("px"), (F.col("e") % HEIGHT).cast("double").alias("py"), (F.col("n") % 7 + 2).cast("double").alias("pr"))


_POINTS = f"select (user_id % 2)::int map_id, user_id pid, (floor(max(value) / 8) % 64)::double px, (max(event_id) % {HEIGHT})::double py, (count(*) % 7 + 2)::double pr from events group by user_id"
_REFS = "values " + ", ".join(str((i, CLASS_NAMES.index(n), *rgb)) for i, (n, rgb) in enumerate((n, rgb) for n, every in REFERENCE_COLORS.items() for rgb in every))
_FINE = "[" + ", ".join(f"{c}::double" for c in Settings().fine_costs()) + "]"


@query(f"""{_COLORS}, refs(i, k, rr, rg, rb) as ({_REFS}),
    s as (select map_id, y, x, arg_min(k, d * 100 + i) k, min(d) d from (select map_id, y, x, i, k, (r - rr) * (r - rr) + (g - rg) * (g - rg) + (b - rb) * (b - rb) d from c, refs) group by map_id, y, x)
    select map_id, y, x, case when d <= 8100 then k else 10 end::int label from s""")
def nearest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = colors(spark, sf_dir)
    refs = classify.references(pixels.select("map_id").distinct())
    refs = refs.withColumn("ref_idx", F.row_number().over(_window("map_id", "ref_idx")) - 1)
    return classify.nearest_reference(pixels, refs, ["r", "g", "b"], 90.0).select("map_id", "y", "x", "label")


@query(f"""{_RASTER} select map_id, label::int label, ({CLASS_NAMES})[label + 1] as name, count(*) n, round(sum(({_FINE})[label + 1]), 6) total_cost from m group by map_id, label""")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = raster(spark, sf_dir).groupBy("map_id", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(classify.fine_cost(F.col("label"))), 6).alias("total_cost"))
    return counted.join(terrain_class(spark).select(F.col("id").alias("label"), "name"), "label").select("map_id", "label", "name", "n", "total_cost")


@query(f"""{_COLORS}, q as (select map_id, quantile_cont(0.299::double * r + 0.587::double * g + 0.114::double * b, 0.95) cut from c group by map_id),
    w as (select map_id, 255.0::double / greatest(avg(r), 1.0::double) fr, 255.0::double / greatest(avg(g), 1.0::double) fg, 255.0::double / greatest(avg(b), 1.0::double) fb, count(*) n
          from c join q using (map_id) where 0.299::double * r + 0.587::double * g + 0.114::double * b >= cut - 1e-9 group by map_id)
    select map_id, y, x, floor(least(255, greatest(0, r * fr)))::int r, floor(least(255, greatest(0, g * fg)))::int g, floor(least(255, greatest(0, b * fb)))::int b from c join w using (map_id)""")
def white_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color.white_balance(colors(spark, sf_dir)).select("map_id", "y", "x", "r", "g", "b")


def _lab_sql() -> str:
    def lin(c: str) -> str:
        return f"case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92::double else pow(({c} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) end"

    def f(t: str) -> str:
        return f"case when {t} > 0.008856 then cbrt({t}) else 7.787::double * {t} + 16.0::double / 116.0::double end"

    return f"""{_COLORS}, l as (select map_id, y, {lin("r")} r, {lin("g")} g, {lin("b")} b from c),
        xyz as (select map_id, y, (0.412453::double * r + 0.357580::double * g + 0.180423::double * b) / 0.950456::double xx, 0.212671::double * r + 0.715160::double * g + 0.072169::double * b yy,
                  (0.019334::double * r + 0.119193::double * g + 0.950227::double * b) / 1.088754::double zz from l),
        lab as (select map_id, y, case when yy > 0.008856 then 116.0::double * cbrt(yy) - 16.0::double else 903.3::double * yy end l, 500.0::double * ({f("xx")} - {f("yy")}) a, 200.0::double * ({f("yy")} - {f("zz")}) b from xyz)
        select map_id, y, round(avg(l), 5) l, round(avg(a), 5) a, round(avg(b), 5) b, round(avg(greatest(0, least(1, (a - 0.5::double * b - 10) / 50))), 5) purple from lab group by map_id, y"""


@query(_lab_sql())
def lab_and_purple(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = color.with_lab(colors(spark, sf_dir))
    score = color.purple_score(F.col("a"), F.col("lab_b"))
    return lab.groupBy("map_id", "y").agg(F.round(F.avg("l"), 5).alias("l"), F.round(F.avg("a"), 5).alias("a"), F.round(F.avg("lab_b"), 5).alias("b"), F.round(F.avg(score), 5).alias("purple"))


_SAMPLES = [(0, "yellow", 3, 4), (0, "GREEN", 0, 0), (1, "green", 61, 9), (0, "PINK", 5, 5), (1, "BLUE", 900, 1), (1, "unknown", 7, 7), (1, "Grey", 30, 249)]


@query(f"""{_COLORS}, s(map_id, n, sx, sy) as (values {", ".join(map(str, _SAMPLES))}), e as (select map_id, max(x) w, max(y) h from c group by map_id)
    select map_id, (list_position({CLASS_NAMES[:-1]}, upper(n)) - 1)::int class_id, sx::int sx, sy::int sy, floor(avg(r))::int r, floor(avg(g))::int g, floor(avg(b))::int b
    from s join e using (map_id) join c using (map_id) where list_position({CLASS_NAMES[:-1]}, upper(n)) is not null and sx between 0 and w and sy between 0 and h and abs(x - sx) <= 2 and abs(y - sy) <= 2 group by map_id, n, sx, sy""")
def color_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame(_SAMPLES, "map_id int, class_name string, sx int, sy int")
    return classify.sample_references(colors(spark, sf_dir), samples).select("map_id", F.col("class_id").cast("int").alias("class_id"), "sx", "sy", "r", "g", "b")


@query(f"""{_RASTER}, l as (select map_id, y, x, case when v % 7 = 0 then 10 else label end k from m),
    n as (select a.map_id, a.y, a.x, b.k, count(*) n from l a join l b on a.map_id = b.map_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 where a.k = 10 and b.k <> 10 group by 1, 2, 3, 4),
    best as (select map_id, y, x, arg_max(k, n * 100 - k) k from n group by map_id, y, x)
    select l.map_id, l.y, l.x, coalesce(best.k, l.k)::int label from l left join best using (map_id, y, x)""")
def majority_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = raster(spark, sf_dir).select("map_id", "y", "x", F.when(F.col("v") % 7 == 0, 10).otherwise(F.col("label")).cast("int").alias("label"))
    return stencil.majority_fill(plane, "label", 10, passes=1).select("map_id", "y", "x", "label")


_CELLS = f"""{_RASTER}, p as (select *, v % 5 = 0 f, v % 97 = 0 bar from m),
    g as (select map_id, (y // 4)::int r, (x // 4)::int c, avg(({_FINE})[label + 1]) filter (where not f) mean, bool_or(bar) bar from p group by 1, 2, 3),
    s as (select *, bar or mean is null shut from g),
    w as (select *, coalesce(lead(shut) over (partition by map_id, r order by c), false) e, coalesce(lag(shut) over (partition by map_id, r order by c), false) w, coalesce(lead(shut) over (partition by map_id, c order by r), false) d from s),
    cells as (select map_id, r, c, case when shut or (e or w) and d then 'infinity'::double else mean end cost, bar from w)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = raster(spark, sf_dir).withColumns({"forbidden": F.col("v") % 5 == 0, "barrier": F.col("v") % 97 == 0})
    return terrain.cost_cells(plane, 4)


@query(f"{_CELLS} select map_id, r, c, cost = 'infinity'::double shut, case when cost < 'infinity'::double then round(cost, 6) end cost, bar barrier from cells")
def block_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("map_id", "r", "c", (F.col("cost") == INF).alias("shut"), F.when(F.col("cost") < INF, F.round("cost", 6)).alias("cost"), "barrier")


@query(f"""{_CELLS.replace("y // 4", "y // sz").replace("x // 4", "x // sz").replace("p as (select *,", "p as (select *, 2 + map_id % 3 sz,")} select map_id, r, c, cost = 'infinity'::double shut, case when cost < 'infinity'::double then round(cost, 6) end cost, bar barrier from cells""")
def cells_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost cells of maps that were scanned at different resolutions, cells being equally large on paper."""
    plane = written(raster(spark, sf_dir).withColumns({"forbidden": F.col("v") % 5 == 0, "barrier": F.col("v") % 97 == 0}))
    scales = plane.select("map_id").distinct().withColumn("px_per_mm", (2 + F.col("map_id") % 3) / F.lit(Settings().cell_mm))

    def made(maps: DataFrame, px_per_mm: float) -> DataFrame:
        return terrain.cost_cells(plane.join(maps, "map_id", "left_semi"), terrain.cell_size(px_per_mm))

    found = analysis.at_own_scale(scales, made)
    return found.select("map_id", "r", "c", (F.col("cost") == INF).alias("shut"), F.when(F.col("cost") < INF, F.round("cost", 6)).alias("cost"), "barrier")


@query(f"""{_RASTER}, w as (select *, coalesce(lead(m3) over (partition by map_id, y order by x), false) e, coalesce(lag(m3) over (partition by map_id, y order by x), false) w, coalesce(lead(m3) over (partition by map_id, x order by y), false) d from m)
    select map_id, y, x, m3 or (e or w) and d closed from w""")
def diag_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.close_diagonals(raster(spark, sf_dir), "m3", "closed").select("map_id", "y", "x", "closed")


@query(f"""{_RASTER}, a as (select *, sum(m3::int) over (partition by map_id, y order by x rows between 2 preceding and 2 following) s, count(*) over (partition by map_id, y order by x rows between 2 preceding and 2 following) k from m)
    select map_id, y, x, sum(s) over (partition by map_id, x order by y rows between 2 preceding and 2 following)::double / sum(k) over (partition by map_id, x order by y rows between 2 preceding and 2 following)::double density from a""")
def box_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.density(raster(spark, sf_dir), "m3", 2).select("map_id", "y", "x", "density")


def _square_sql(source: str, col: str, how: str, name: str) -> str:
    over = "rows between 1 preceding and 1 following"
    return f"""{name}_r as (select map_id, y, x, {how}({col}) over (partition by map_id, y order by x {over}) t from {source}),
        {name} as (select map_id, y, x, {how}(t) over (partition by map_id, x order by y {over}) t from {name}_r)"""


@query(f"""{_RASTER}, {_square_sql("m", "m3::int", "max", "dil")}, {_square_sql("dil", "t", "min", "clo")}, {_square_sql("m", "(not m3)::int", "min", "ero")}, {_square_sql("ero", "t", "max", "ope")}
    select map_id, y, x, dil.t = 1 dilated, clo.t = 1 closed, ero.t = 1 eroded, ope.t = 1 opened from dil join clo using (map_id, y, x) join ero using (map_id, y, x) join ope using (map_id, y, x)""")
def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = raster(spark, sf_dir).withColumn("n3", ~F.col("m3"))
    plane = stencil.closed(stencil.dilate(plane, "m3", 1, "dilated"), "m3", 1, "closed")
    return stencil.opened(stencil.erode(plane, "n3", 1, "eroded"), "n3", 1, "opened").select("map_id", "y", "x", "dilated", "closed", "eroded", "opened")


def _spread_sql(mask: str, near: str) -> str:
    return f"""{_RASTER.replace("with r", "with recursive r")}, p as (select map_id, y, x from m where {mask}),
        t as (select map_id, y, x, y ry, x rx from p union select b.map_id, b.y, b.x, t.ry, t.rx from t join p b on b.map_id = t.map_id and {near}),
        comp as (select map_id, y, x, min(ry * 1000 + rx) k from t group by map_id, y, x)"""


_NEXT8 = "abs(b.y - t.y) <= 1 and abs(b.x - t.x) <= 1 and (b.y <> t.y or b.x <> t.x)"


@query(f"""{_spread_sql("m4", _NEXT8)}
    select map_id, (k // 1000)::int cy, (k % 1000)::int cx, count(*) area, min(x)::int x0, max(x)::int x1, min(y)::int y0, max(y)::int y1 from comp group by map_id, k""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = graph.component_stats(graph.mask_components(raster(spark, sf_dir).where("m4").select("map_id", "y", "x")))
    return stats.select("map_id", F.col("comp.y").alias("cy"), F.col("comp.x").alias("cx"), "area", "x0", "x1", "y0", "y1")


@query(f"""{_spread_sql("m4", _NEXT8)},
    b as (select map_id, k, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h from comp group by map_id, k)
    select map_id, (k // 1000)::int cy, (k % 1000)::int cx from b where greatest(w, h) >= 12 or greatest(w, h) >= 3 * least(w, h) and greatest(w, h) >= 6""")
def line_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = graph.component_stats(graph.mask_components(raster(spark, sf_dir).where("m4").select("map_id", "y", "x")))
    return graph.line_like(stats, 6.0).select("map_id", F.col("comp.y").alias("cy"), F.col("comp.x").alias("cx"))


@query(f"""{_spread_sql("m4", "abs(b.y - t.y) + abs(b.x - t.x) = 1")}, e as (select map_id, max(y) h, max(x) w from m group by map_id),
    outer_k as (select distinct map_id, k from comp join e using (map_id) where y = 0 or x = 0 or y = h or x = w)
    select m.map_id, m.y, m.x, not m4 or (comp.k is not null and outer_k.k is null) filled from m left join comp using (map_id, y, x) left join outer_k on outer_k.map_id = comp.map_id and outer_k.k = comp.k""")
def holes_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = raster(spark, sf_dir).select("map_id", "y", "x", (~F.col("m4")).alias("on"))
    return graph.fill_holes(plane).select("map_id", "y", "x", F.col("on").alias("filled"))


@query(f"""{_RASTER}, n as (select a.map_id, a.y, a.x, arg_min(b.label, ((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) * 10000000000 + b.y * 100000 + b.x) k
        from m a join m b on a.map_id = b.map_id and abs(a.y - b.y) <= 8 and abs(a.x - b.x) <= 8 where a.m3 and not b.m3 group by a.map_id, a.y, a.x)
    select m.map_id, m.y, m.x, coalesce(k, label)::int label from m left join n using (map_id, y, x)""")
def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.fill_from_nearest(raster(spark, sf_dir), "label", "m3").select("map_id", "y", "x", "label")


_CELL_EDGE = "e as (select map_id, max(r) h, max(c) w from cells group by map_id)"


@query(f"""{_CELLS}, pts as ({_POINTS}), {_CELL_EDGE},
    q as (select map_id, pid, greatest(0, least(h, floor(py / 4))) r0, greatest(0, least(w, floor(px / 4))) c0 from pts join e using (map_id))
    select map_id, pid, (k // 1000 % 1000)::int r, (k % 1000)::int c from (
      select map_id, pid, min(((r - r0) * (r - r0) + (c - c0) * (c - c0))::bigint * 1000000 + r * 1000 + c) k from q join cells using (map_id) where cost < 'infinity'::double group by map_id, pid)""")
def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir)
    ground = grid.where(F.col("cost") < INF).select("map_id", "r", "c")
    return nearest.snap(points(spark, sf_dir), grid, ground, 4).select("map_id", "pid", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))


_EDITS = [(0, "e1", "forbid", [(5, 3), (30, 3), (30, 40), (5, 25)]), (0, "e2", "allow", [(10, 10), (25, 18), (12, 30)]), (0, "e3", "forbid", [(1, 1), (2, 2)]), (1, "e4", "forbid", [(0, 100), (63, 120), (20, 140)])]


def edits(spark: SparkSession) -> DataFrame:
    rows = [(m, i, k, [(float(x), float(y)) for x, y in p]) for m, i, k, p in _EDITS]
    return spark.createDataFrame(rows, "map_id int, edit_id string, kind string, points array<struct<x:double,y:double>>")


def _polygon_sql() -> str:
    edges = ", ".join(str((m, i, k, *a, *b)) for m, i, k, p in _EDITS if len(p) >= 3 for a, b in zip(p, p[1:] + p[:1], strict=True))
    return f"""{_RASTER}, e(map_id, id, kind, ax, ay, bx, dy) as (values {edges}),
        t as (select map_id, id, kind, y, x, bool_or((bx - ax) * (y - ay) = (x - ax) * (dy - ay) and x between least(ax, bx) and greatest(ax, bx) and y between least(ay, dy) and greatest(ay, dy)) on_edge,
                count(*) filter (where (ay > y) <> (dy > y) and case when dy > ay then (bx - ax) * (y - ay) - (x - ax) * (dy - ay) > 0 else (bx - ax) * (y - ay) - (x - ax) * (dy - ay) < 0 end) n
              from m join e using (map_id) group by 1, 2, 3, 4, 5),
        inside as (select map_id, id, kind, y, x from t where on_edge or n % 2 = 1)"""


@query(f"{_polygon_sql()} select map_id, id edit_id, kind, y, x from inside")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.polygon_pixels(raster(spark, sf_dir), edits(spark)).select("map_id", "edit_id", "kind", "y", "x")


@query(f"""{_polygon_sql()}, f as (select *, label in (5, 4) or v % 13 = 0 or v % 17 = 0 or v % 19 = 0 or v % 23 = 0 or v % 29 = 0 bad, v % 29 = 0 bar from m),
    s as (select map_id, y, x, bool_or(kind = 'forbid') f, bool_or(kind = 'allow') a from inside group by map_id, y, x)
    select f.map_id, f.y, f.x, (bad or coalesce(s.f, false)) and not coalesce(a, false) forbidden, bar and not coalesce(a, false) barrier from f left join s using (map_id, y, x)""")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {n: F.col("v") % k == 0 for n, k in (("hatch", 13), ("outside", 17), ("outline", 19), ("water", 23), ("barrier", 29))}
    plane = raster(spark, sf_dir).withColumns(flags).withColumn("forbidden", terrain.forbidden())
    masks = terrain.polygon_pixels(plane, edits(spark))
    return terrain.apply_edits(plane, masks, ["forbidden", "barrier"]).select("map_id", "y", "x", "forbidden", "barrier")


@query(f"""{_polygon_sql()}, said as (select map_id, y, x, bool_or(kind = 'forbid') f, bool_or(kind = 'allow') a from inside group by map_id, y, x),
    p as (select m.map_id, m.y, m.x, label, (v % 5 = 0 or coalesce(said.f, false)) and not coalesce(said.a, false) f, v % 97 = 0 and not coalesce(said.a, false) bar from m left join said using (map_id, y, x)),
    {_CELLS[_CELLS.index("g as (select map_id, (y // 4)"):]} select map_id, r, c, cost = 'infinity'::double shut, case when cost < 'infinity'::double then round(cost, 6) end cost, bar barrier from cells""")
def cells_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost cells brought from every other edit to all of them, only cells near changed ones made anew."""
    plane = raster(spark, sf_dir).withColumns({"forbidden": F.col("v") % 5 == 0, "barrier": F.col("v") % 97 == 0})
    every = edits(spark)
    before = every.where(F.pmod(F.xxhash64("edit_id"), F.lit(2)) == 0)
    start = terrain.cost_cells(terrain.apply_edits(plane, terrain.polygon_pixels(plane, before), ["forbidden", "barrier"]), 4)
    found = terrain.edited_cells(plane, start, before, every, 4)
    return found.select("map_id", "r", "c", (F.col("cost") == INF).alias("shut"), F.when(F.col("cost") < INF, F.round("cost", 6)).alias("cost"), "barrier")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("l_linenumber"), F.col("l_suppkey") % 15, F.col("l_partkey") % 12000
    text = F.when(F.col("l_orderkey") % 4 == 0, F.concat_ws("/", a, b)).when(F.col("l_orderkey") % 4 == 1, F.concat(a, F.lit("/"), b, F.lit("-"), c)).when(F.col("l_orderkey") % 4 == 2, F.concat(F.lit(" "), b, F.lit("-"), c)).otherwise(F.concat(F.lit("-"), a))
    return _table(spark, sf_dir, "lineitem").select(text.alias("text")).distinct()


_LABEL_SQL = r"""with l as (select l_linenumber::varchar a, (l_suppkey % 15)::varchar b, (l_partkey % 12000)::varchar c, l_orderkey % 4 k from lineitem),
    t as (select distinct case k when 0 then a || '/' || b when 1 then a || '/' || b || '-' || c when 2 then ' ' || b || '-' || c else '-' || a end as text from l),
    s as (select text, trim(text) t, regexp_extract(trim(text), '^(\d{1,2}(?:/\d{1,2})*)(?:-(\d{1,4}))?$', 1) o, regexp_extract(trim(text), '^(\d{1,2}(?:/\d{1,2})*)(?:-(\d{1,4}))?$', 2) c from t),
    g as (select *, o <> '' and len(list_filter(string_split(o, '/'), lambda v: try_cast(v as int) < 1)) = 0 good from s)
    select text, case when good then list_transform(string_split(o, '/'), lambda v: try_cast(v as int))::varchar end orders, case when good and c <> '' then c::int end code from g"""


@query(_LABEL_SQL)
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, code = course.parsed_label(F.col("text"))
    listed = F.concat(F.lit("["), F.array_join(orders.cast("array<string>"), ", "), F.lit("]"))
    return _labels(spark, sf_dir).select("text", F.when(orders.isNotNull(), listed).alias("orders"), code.alias("code"))


@query("""with l as (select distinct l_suppkey map_id, l_linenumber node from lineitem), e as (select map_id, node, unnest([(map_id + node) % 6 + 1, node * 2]) num from l),
    n as (select map_id, count(*) k from l group by map_id), mx as (select l.map_id, k + count(*) most from l join n using (map_id) group by l.map_id, k),
    s as (select map_id, num from e group by 1, 2 having count(*) > 1)
    select distinct map_id, node from e where (map_id, num) in (select map_id, num from s) or num > (select most from mx where mx.map_id = e.map_id)""")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("map_id"), F.col("l_linenumber").alias("node")).distinct()
    counted = nodes.join(nodes.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_controls")), "map_id")
    labels = counted.withColumn("orders", F.array((F.col("map_id") + F.col("node")) % 6 + 1, (F.col("node") * 2).cast("long")))
    return course.conflicting(labels)


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("order", F.row_number().over(_window("user_id", "ts", "event_id")))
    return events.select(F.col("user_id").alias("map_id"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 != 0, F.col("order")).alias("order"), F.col("value").alias("x"), (F.col("event_id") % 500).cast("double").alias("y"), F.col("event_type").alias("kind"))


def _window(by: str, *order: str | Column):
    return Window.partitionBy(by).orderBy(*order)


_CONTROLS = """with c as (select user_id map_id, event_id id, case when event_id % 11 <> 0 then row_number() over (partition by user_id order by ts, event_id) end ord, value x, (event_id % 500)::double y, event_type kind from events),
    l as (select map_id, id from_id, x fx, y fy, lead(id) over w to_id, lead(x) over w tx, lead(y) over w ty from c where ord is not null window w as (partition by map_id order by ord, id))"""


@query(f"{_CONTROLS} select map_id, from_id, to_id, round(sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy)), 4) length_px, round(sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy)) * (4000 / 1000.0::double / 6.0::double), 3) length_m from l where to_id is not null")
def course_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = routing.consecutive(_controls(spark, sf_dir))

    def point(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    length = routing.path_length(F.array(point("from_x", "from_y"), point("to_x", "to_y")))
    return legs.select("map_id", "from_id", "to_id", F.round(length, 4).alias("length_px"), F.round(length * routing.metres_per_pixel(F.lit(4000), F.lit(None).cast("double")), 3).alias("length_m"))


_OFF = "sqrt((p.x - a.x - t * (b.x - a.x)) * (p.x - a.x - t * (b.x - a.x)) + (p.y - a.y - t * (b.y - a.y)) * (p.y - a.y - t * (b.y - a.y)))"
_ALONG = "case when (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) > 0 then greatest(0.0::double, least(1.0::double, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))) else 0.0::double end"


@query(f"""with recursive p as (select user_id map_id, row_number() over (partition by user_id order by ts, event_id) n, value x, (event_id % 500)::double y from events),
    s(map_id, i, j) as (select map_id, 1::bigint, max(n) from p group by map_id
      union all select map_id, unnest([i, k]), unnest([k, j]) from (
        select s.map_id, i, j, arg_max(p.n, {{'off': {_OFF.replace(" t ", f" ({_ALONG}) ")}, 'n': -p.n}}) k from s join p on p.map_id = s.map_id and p.n > i and p.n < j join p a on a.map_id = s.map_id and a.n = i join p b on b.map_id = s.map_id and b.n = j
        where {_OFF.replace(" t ", f" ({_ALONG}) ")} > 150 group by s.map_id, i, j))
    select map_id, n, x, y from p where exists (select 1 from s where s.map_id = p.map_id and (s.i = p.n or s.j = p.n))""")
def paths_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's way through the plane, without the points that a line within 150 of all of them can spare."""
    n = F.row_number().over(_window("user_id", "ts", "event_id")).cast("long")
    way = _table(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), F.lit(0).alias("leg"), n.alias("n"), F.col("value").alias("x"), (F.col("event_id") % 500).cast("double").alias("y"))
    return routing.simplified(way, 150.0).select("map_id", "n", "x", "y")


@query(f"{_CONTROLS} select l.map_id, coalesce(a.kind, '?') from_kind, coalesce(b.kind, '?') to_kind, count(*) n from l left join c a on a.id = l.from_id left join c b on b.id = l.to_id and b.id % 3 <> 0 where to_id is not null group by 1, 2, 3")
def leg_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = _controls(spark, sf_dir)
    legs = routing.consecutive(controls).select("map_id", "from_id", "to_id")
    a = controls.select(F.col("id").alias("from_id"), F.col("kind").alias("from_kind"))
    b = controls.where("id % 3 <> 0").select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    named = legs.join(a, "from_id", "left").join(b, "to_id", "left").fillna("?", ["from_kind", "to_kind"])
    return named.groupBy("map_id", "from_kind", "to_kind").agg(F.count(F.lit(1)).alias("n"))


def _ring_sql(offsets: str, name: str = "h", n: int = 72) -> str:
    """Whether each angle of each circle ``(map_id, pid, px, py, pr)`` of ``c`` hits the mask at one of the radial offsets."""
    return f"""a_{name} as (select c.*, k, o from c, (select unnest(range(0, {n})) k), (select unnest({offsets}) o)),
        {name} as (select map_id, pid, pr, k, bool_or(m3 is not null) hit from (select a.*, m.m3 from a_{name} a left join (select map_id, y, x, m3 from m where m3) m on m.map_id = a.map_id
            and m.x = round_even(px + (pr + o) * cos(k * (2 * pi() / {n})), 0)::int and m.y = round_even(py + (pr + o) * sin(k * (2 * pi() / {n})), 0)::int) group by map_id, pid, pr, k)"""


_TIGHT = "[-1.0::double, -0.5::double, 0.0::double, 0.5::double, 1.0::double]"


def _circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumnsRenamed({"pid": "cid", "px": "cx", "py": "cy", "pr": "cr"})


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).where("m3").select("map_id", "y", "x")


@query(f"""{_RASTER}, c as ({_POINTS}), {_ring_sql(_TIGHT)}, s as (select map_id, pid, k // 9 sec, sum(hit::int) n from h group by 1, 2, 3)
    select map_id, pid cid, round(sum(n) / 72.0::double, 6) support, round(avg((n >= 2.25)::int), 6) coverage from s group by map_id, pid""")
def ring_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.ring_support(_circles(spark, sf_dir), _mask(spark, sf_dir), F.lit(1.0))
    return found.select("map_id", "cid", F.round("support", 6).alias("support"), F.round("coverage", 6).alias("coverage"))


@query(f"""{_RASTER}, c as ({_POINTS})
    select map_id, pid cid, round(avg(m3::int), 6) fill from c join m using (map_id) where (x - px) * (x - px) + (y - py) * (y - py) <= (pr * 0.6::double) * (pr * 0.6::double) group by map_id, pid""")
def interior_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = raster(spark, sf_dir).groupBy("map_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    found = rings.interior_fill(_circles(spark, sf_dir), _mask(spark, sf_dir), size)
    return found.select("map_id", "cid", F.round("fill", 6).alias("fill"))


@query(f"""with c as ({_POINTS}), n as (select a.map_id, a.pid, sum(b.px + 1) score, count(*) n, sum(b.pr * (b.px + 1)) / sum(b.px + 1) mean from c a join c b on a.map_id = b.map_id and abs(b.pr - a.pr) <= 0.08::double * a.pr group by a.map_id, a.pid)
    select map_id, case when n >= 3 then r0 end r0, n from (select map_id, round(arg_max(mean, score * 1000000 - pid), 6) r0, arg_max(n, score * 1000000 - pid) n from n group by map_id)""")
def radius_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    circles = _circles(spark, sf_dir).withColumn("support", F.col("cx") + 1)
    return rings.radius_consensus(circles).select("map_id", F.round("r0", 6).alias("r0"), "n")


@query(f"""with recursive c as (select *, row_number() over (partition by map_id order by px desc, pr desc, pid) n from ({_POINTS})),
    t as (select map_id, 0::bigint n, []::bigint[] ids, []::double[] xs, []::double[] ys from (select distinct map_id from c)
      union all select c.map_id, c.n, case when far then list_append(ids, c.pid) else ids end, case when far then list_append(xs, c.px) else xs end, case when far then list_append(ys, c.py) else ys end
      from (select t.map_id m, t.n k, ids, xs, ys, c.*, len(list_filter(range(1, len(xs) + 1), lambda i: sqrt((xs[i] - c.px) * (xs[i] - c.px) + (ys[i] - c.py) * (ys[i] - c.py)) < 12)) = 0 far
            from t join c on c.map_id = t.map_id and c.n = t.n + 1) c),
    last as (select map_id, arg_max(ids, n) ids from t group by map_id)
    select c.map_id, pid cid, px cx, py cy, pr cr from c join last using (map_id) where list_contains(ids, pid)""")
def circles_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    circles = _circles(spark, sf_dir).withColumn("support", F.col("cx") + 1)
    return rings.suppressed(circles, F.lit(12.0)).select("map_id", "cid", "cx", "cy", "cr")


_CANDIDATES = f"""c as ({_POINTS}), b as (select map_id, pid lid, px + 3 x0, py - 2 y0, px + 9 x1, py + 2 y1 from c),
    cand as (select * from (select b.map_id, lid, pid node, sqrt(pow(greatest(x0 - px, 0, px - x1), 2) + pow(greatest(y0 - py, 0, py - y1), 2)) dist from b join c using (map_id)) where dist <= 9)"""


@query(f"with {_CANDIDATES} select map_id, lid, node, round(dist, 6) dist from cand")
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point has a label to its right, which may lie nearer to other points."""
    boxes, circles = _boxes_and_circles(spark, sf_dir)
    return course.label_candidates(boxes, circles, F.lit(3.0)).select("map_id", "lid", "node", F.round("dist", 6).alias("dist"))


def _boxes_and_circles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = points(spark, sf_dir)
    boxes = at.select("map_id", F.col("pid").alias("lid"), (F.col("px") + 3).alias("x0"), (F.col("py") - 2).alias("y0"), (F.col("px") + 9).alias("x1"), (F.col("py") + 2).alias("y1"))
    return boxes, at.select("map_id", F.col("pid").alias("node"), F.col("px").alias("cx"), F.col("py").alias("cy"))


@query(f"""with recursive {_CANDIDATES}, o as (select *, row_number() over (partition by map_id order by dist, lid, node) n from cand),
    t as (select map_id, 0::bigint n, []::bigint[] ls, []::bigint[] ns from (select distinct map_id from o)
      union all select map_id, k, case when free then list_append(ls, lid) else ls end, case when free then list_append(ns, node) else ns end
      from (select t.map_id, o.n k, ls, ns, lid, node, not list_contains(ls, lid) and not list_contains(ns, node) free from t join o on o.map_id = t.map_id and o.n = t.n + 1)),
    last as (select map_id, arg_max(ls, n) ls, arg_max(ns, n) ns from t group by map_id)
    select map_id, unnest(ls) lid, unnest(ns) node from last""")
def labels_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, circles = _boxes_and_circles(spark, sf_dir)
    return course.matched_boxes(boxes, circles, F.lit(3.0)).select("map_id", "lid", "node")


def _distance_sql(start: str) -> str:
    """Least costs ``d(map_id, leg, r, c, d)`` over ``grid`` from the cells ``s0(map_id, leg, r, c)`` that ``start`` selects."""
    step = "d.d + sqrt(((g.r - d.r) * (g.r - d.r) + (g.c - d.c) * (g.c - d.c))::double) * (g.cost + o.cost) / 2"
    return f"""{_CELLS.replace("with r as", "with recursive r as")}, grid as (select map_id, r, c, cost from cells where cost < 'infinity'::double), {start},
    d(map_id, leg, r, c, d) using key (map_id, leg, r, c) as (select map_id, leg, r, c, 0.0::double from s0
      union all select d.map_id, d.leg, g.r, g.c, min({step}) n
      from d join grid o on o.map_id = d.map_id and o.r = d.r and o.c = d.c join grid g on g.map_id = d.map_id and abs(g.r - d.r) <= 1 and abs(g.c - d.c) <= 1 and (g.r <> d.r or g.c <> d.c)
        left join recurring.d k on k.map_id = d.map_id and k.leg = d.leg and k.r = g.r and k.c = g.c
      where k.d is null or {step} < k.d - 1e-12 group by d.map_id, d.leg, g.r, g.c)"""


@query(f"""{_distance_sql("s0 as (select map_id, 'a' leg, k // 1000 r, k % 1000 c from (select map_id, min(r * 1000 + c) k from grid group by map_id))")}
    select map_id, r::int r, c::int c, round(d, 6) d from d""")
def least_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir)
    start = grid.where(F.col("cost") < INF).groupBy("map_id").agg(F.min(F.struct("r", "c")).alias("s")).select("map_id", F.lit("a").alias("leg"), "s.r", "s.c")
    return routing.spread(grid, start, tile=16).select("map_id", "r", "c", F.round("d", 6).alias("d"))


@query(f"""{_CELLS}, n as (select map_id, r, c, case when cost < 'infinity'::double then round(cost, 9) end cost from cells), e as (select map_id, min(cost) lo, max(cost) hi from n group by map_id),
    t as (select map_id, r, c, cost, case when hi > lo then (cost - lo) / (hi - lo) else 0.0::double end t from n join e using (map_id))
    select map_id, r, c, case when cost is not null then floor(255 * t)::int else 40 end red, case when cost is not null then floor(255 * (1 - t))::int else 0 end green, 40 blue from t""")
def cost_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ramp = classify.cost_ramp(cells(spark, sf_dir).withColumnRenamed("r", "row"))
    return ramp.select("map_id", F.col("row").alias("r"), "c", F.col("r").alias("red"), F.col("g").alias("green"), F.col("b").alias("blue"))


_PALETTE = ", ".join(f"({[DISPLAY_COLORS[n][i] for n in CLASS_NAMES]})[label + 1]::int {c}" for i, c in enumerate("rgb"))


@query(f"{_RASTER} select map_id, y, x, {_PALETTE} from m")
def palette_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = raster(spark, sf_dir).withColumns({k: v for k, v in classify.palette(F.col("label")).items() if k != "alpha"})
    return shown.select("map_id", "y", "x", "r", "g", "b")


@query(f"{_RASTER} select map_id, y - 10 + 7 y, x - 8 + 5 x, label::int label from m where x between 8 and 39 and y between 10 and 199")
def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop, and its layer placed in another picture."""
    return classify.placed(classify.crop(raster(spark, sf_dir), (8, 10, 40, 200)), 5, 7).select("map_id", "y", "x", "label")


@query(f"{_RASTER} select map_id, y, x, case when m3 then 10 else 0 end r, case when m3 then 20 else 0 end g, case when m3 then 30 else 0 end b, case when m3 then 40 else 0 end alpha from m")
def mask_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).withColumns(classify.mask_rgba(F.col("m3"), (10, 20, 30, 40))).select("map_id", "y", "x", "r", "g", "b", "alpha")


@query(f"""{_CELLS}, e as (select map_id, max(y) h, max(x) w from m group by map_id)
    select map_id, (r * 4 + i)::int y, (c * 4 + j)::int x, barrier from (select map_id, r, c, bar barrier, unnest(range(0, 4)) i from cells), (select unnest(range(0, 4)) j) join e using (map_id) where r * 4 + i <= h and c * 4 + j <= w""".replace("join e using (map_id)", "").replace("), (select unnest(range(0, 4)) j)", ") q cross join (select unnest(range(0, 4)) j) join e using (map_id)"))
def cells_enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = raster(spark, sf_dir).groupBy("map_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return classify.enlarged(cells(spark, sf_dir), 4, size).select("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "barrier")


@query("select user_id project_id, event_id version, event_type kind from (select *, row_number() over (partition by user_id order by event_id desc) k from events) where k = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("version"), F.col("event_type").alias("kind"))
    return projects.latest(versions)


@query(f"{_CONTROLS} select map_id, id, row_number() over (partition by map_id order by ord nulls last, id) place, case when ord is not null then row_number() over (partition by map_id order by ord nulls last, id) - 1 end renumbered from c")
def control_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(_window("map_id", F.asc_nulls_last("order"), "id"))
    return _controls(spark, sf_dir).select("map_id", "id", place.cast("long").alias("place"), F.when(F.col("order").isNotNull(), place.cast("long") - 1).alias("renumbered"))


@query("select doc_id, sha256(text) sha from documents")
def content_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"""{_RASTER} select a.map_id, a.y, a.x, (count(b.x) - 1)::bigint n8 from m a join m b on a.map_id = b.map_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and b.m3 where a.m3 group by 1, 2, 3 having count(b.x) - 1 >= 3""")
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.neighbours8(raster(spark, sf_dir), "m3").where("m3 and n8 >= 3").select("map_id", "y", "x", "n8")


@query(f"""{_RASTER}, c as ({_POINTS}), a as (select map_id, pid, px, py, pr, k, unnest(range(0, floor((pr + 0.01) * 2)::int + 1)) i from c, (select unnest(range(0, 72)) k)),
    b as (select *, pr + (i * 0.5::double - 0.5::double * pr) rr from a),
    h as (select b.map_id, pid, k, pr, bool_or(y is not null and rr < 0.7::double * pr) inn, bool_or(y is not null and rr > 1.3::double * pr) ou, count(y) * 0.5::double ink
          from b left join (select map_id, y, x from m where m3) m on m.map_id = b.map_id and m.x = round_even(px + rr * cos(k * (2 * pi() / 72)), 0)::int and m.y = round_even(py + rr * sin(k * (2 * pi() / 72)), 0)::int group by b.map_id, pid, k, pr)
    select map_id, pid cid, round(avg(inn::int), 6) "inner", round(avg(ou::int), 6) "outer", round(quantile_cont(ink, 0.5) / pr, 6) thickness from h group by map_id, pid, pr""")
def ring_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.band_stats(_circles(spark, sf_dir), _mask(spark, sf_dir))
    return found.select("map_id", "cid", *[F.round(c, 6).alias(c) for c in ("inner", "outer", "thickness")])


_PAIRS = f"pt as ({_POINTS}), pairs as (select * from (select map_id, pid i, px ax, py ay, pr ar, lead(pid) over w j, lead(px) over w bx, lead(py) over w \"by\", lead(pr) over w br from pt window w as (partition by map_id order by pid)) where j is not null)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _window("map_id", "pid")
    nxt = [F.lead(c).over(w).alias(n) for c, n in (("pid", "j"), ("px", "bx"), ("py", "by"), ("pr", "br"))]
    return points(spark, sf_dir).select("map_id", F.col("pid").alias("i"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("pr").alias("ar"), *nxt).where("j is not null")


@query(f"""{_RASTER}, {_PAIRS}, d as (select *, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) d from pairs), t as (select *, ar + 0.15::double * 4 t0, d - br - 0.15::double * 4 t1 from d),
    s as (select *, unnest(range(0, ceil(t1 - t0)::int)) st from t where t1 - t0 >= 3), o as (select *, unnest([-1.5::double, -0.75::double, 0.0::double, 0.75::double, 1.5::double]) o from s),
    h as (select o.map_id, i, st, bool_or(m.y is not null) hit from o left join (select map_id, y, x from m where m3) m
          on m.map_id = o.map_id and m.x = round_even(ax + (bx - ax) / d * (t0 + st) - ("by" - ay) / d * o, 0)::int and m.y = round_even(ay + ("by" - ay) / d * (t0 + st) + (bx - ax) / d * o, 0)::int group by o.map_id, i, st)
    select pairs.map_id, pairs.i, pairs.j, round(coalesce(x.s, 0), 6) support from pairs left join (select map_id, i, avg(hit::int) s from h group by map_id, i) x on x.map_id = pairs.map_id and x.i = pairs.i""")
def line_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.line_support(_pairs(spark, sf_dir), _mask(spark, sf_dir), F.lit(4.0))
    return found.select("map_id", "i", "j", F.round("support", 6).alias("support"))


@query(f"""{_CELLS}, {_PAIRS}, {_CELL_EDGE},
    n as (select *, greatest(2, ceil(sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) / 1.0)::int + 1) n from pairs join e using (map_id)), k as (select *, unnest(range(0, n)) k from n),
    hits as (select map_id, i, greatest(0, least(h, floor((ay + ("by" - ay) * (k / (n - 1)::double)) / 4)))::int r, greatest(0, least(w, floor((ax + (bx - ax) * (k / (n - 1)::double)) / 4)))::int c from k)
    select map_id, i sid, not bool_or(cost = 'infinity'::double) clear from hits join cells using (map_id, r, c) group by map_id, i""")
def segments_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _pairs(spark, sf_dir).withColumnRenamed("i", "sid")
    return routing.segments_clear(segments, cells(spark, sf_dir), 4).select("map_id", "sid", "clear")


@query(f"with p as ({_POINTS}) select map_id, pid cid from p a where not exists (select 1 from p b where a.map_id = b.map_id and a.pid <> b.pid and b.pr >= 7 and sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) < 10) and pr < 7")
def circles_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small circles that no large one is near to."""
    circles = _circles(spark, sf_dir)
    others = circles.where("cr >= 7").select("map_id", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    return rings.away_from(circles.where("cr < 7"), others, F.lit(10.0)).select("map_id", "cid")


_PROFILE = f"""{_RASTER}, pts as ({_POINTS}), c as (select map_id, pid, px, py, unnest([4.0::double + i * 0.5::double for i in range(0, 21)]) pr from pts),
    {_ring_sql("[-0.75::double, -0.25::double, 0.25::double, 0.75::double]")}, prof as (select map_id, pid, pr, avg(hit::int) s from h group by map_id, pid, pr)"""


def _profile(spark: SparkSession, sf_dir: str, mask: DataFrame | None = None) -> DataFrame:
    radii = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: 4.0 + i * 0.5)
    return rings.radial_profile(_circles(spark, sf_dir), _mask(spark, sf_dir) if mask is None else mask, radii)


@query(f"{_PROFILE} select map_id, pid cid, pr radius, round(s, 6) support from prof")
def finish_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).select("map_id", "cid", "radius", F.round("support", 6).alias("support"))


def _skeleton_sql() -> str:
    """Thinning by rounds over the whole plane, more of them than half its width; then segments by spreading, owners by comparing all pairs."""
    row, column = "partition by map_id, y order by x", "partition by map_id, x order by y"
    near = "rows between 1 preceding and 1 following"

    def around(how: str, c: str, source: str) -> str:
        return f"select map_id, y, x, {how}(h) over ({column} {near}) {c} from (select map_id, y, x, {how}({c}) over ({row} {near}) h from {source})"

    ring = ["nn", "ne", "ee", "se", "ss", "sw", "ww", "nw"]
    turns = " + ".join(f"({a} = 0 and {b} = 1)::int" for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    step = f"""select k + 1, map_id, y, x, (o = 1 and not ({" + ".join(ring)} between 2 and 6 and {turns} = 1 and case when k % 2 = 0 then nn * ee * ss = 0 and ee * ss * ww = 0 else nn * ee * ww = 0 and nn * ss * ww = 0 end))::int
        from (select k, map_id, y, x, o, ww, ee, coalesce(lag(o) over c, 0) nn, coalesce(lead(o) over c, 0) ss, coalesce(lag(ee) over c, 0) ne, coalesce(lag(ww) over c, 0) nw, coalesce(lead(ee) over c, 0) se, coalesce(lead(ww) over c, 0) sw
          from (select *, coalesce(lag(o) over r, 0) ww, coalesce(lead(o) over r, 0) ee from thin where k < 70 window r as ({row})) window c as ({column}))"""
    return f"""{_RASTER.replace("with r", "with recursive r")},
        e1 as ({around("min", "o", "(select map_id, y, x, (not m3)::int o from m)")}), e2 as ({around("max", "o", "e1")}), pl as ({around("max", "o", "e2")}),
        thin(k, map_id, y, x, o) as (select 0, map_id, y, x, o from pl union all {step}),
        sk as materialized (select map_id, y, x from thin where k = 70 and o = 1),
        p as materialized (select a.map_id, a.y, a.x from sk a join sk b on b.map_id = a.map_id and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1 group by 1, 2, 3 having count(*) - 1 < 3),
        t as (select map_id, y, x, y ry, x rx from p union select b.map_id, b.y, b.x, t.ry, t.rx from t join p b on b.map_id = t.map_id and {_NEXT8}),
        sg as materialized (select map_id, y, x, min(ry * 1000 + rx) k from t group by map_id, y, x),
        n1 as (select a.map_id, a.y, a.x, min(((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::bigint * 1000000 + b.y * 1000 + b.x) d from pl a join sk b on b.map_id = a.map_id where a.o = 1 group by 1, 2, 3),
        o1 as (select n1.map_id, n1.y, n1.x, k from n1 left join sg on sg.map_id = n1.map_id and sg.y = d // 1000 % 1000 and sg.x = d % 1000),
        n2 as (select a.map_id, a.y, a.x, min(((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::bigint * 1000000 + b.y * 1000 + b.x) d from o1 a join sg b on b.map_id = a.map_id where a.k is null group by 1, 2, 3),
        ow as (select map_id, y, x, k from o1 where k is not null union all select n2.map_id, n2.y, n2.x, sg.k from n2 join sg on sg.map_id = n2.map_id and sg.y = d // 1000 % 1000 and sg.x = d % 1000),
        le as (select map_id, k, count(*) length from sg group by map_id, k)
        select map_id, (k // 1000)::int sy, (k % 1000)::int sx, count(*) area, any_value(length) length, count(*)::double / any_value(length) width from ow join le using (map_id, k) group by map_id, k"""


@query(_skeleton_sql())
def skeleton_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = stencil.opened(raster(spark, sf_dir).withColumn("on", ~F.col("m3")), "on", 1, "__o").select("map_id", "y", "x", F.col("__o").alias("on"))
    plane = written(stencil.dilate(plane, "on", 1, "wide"))
    thin = lines.skeleton(plane, "wide")
    segments = written(lines.stroke_segments(thin))
    return lines.segment_widths(lines.owners(thin, "wide", "skel", segments), segments).select("map_id", F.col("seg.y").alias("sy"), F.col("seg.x").alias("sx"), "area", "length", "width")


_VOTES = f"""{_RASTER}, p as (select map_id, y, x from m where m4),
    sl as (select t.map_id, t.y, t.x, -sum({rings.ALONG}[t.x - b.x + 4] * {rings.ACROSS}[t.y - b.y + 4]) gx, -sum({rings.ALONG}[t.y - b.y + 4] * {rings.ACROSS}[t.x - b.x + 4]) gy
      from p t join p b on b.map_id = t.map_id and abs(b.y - t.y) <= 3 and abs(b.x - t.x) <= 3 group by 1, 2, 3),
    un as (select map_id, y, x, gx::double / sqrt((gx * gx + gy * gy)::double) ux, gy::double / sqrt((gx * gx + gy * gy)::double) uy from sl where gx <> 0 or gy <> 0),
    vo as (select map_id, cr, floor((x + way * cr * ux) / 2)::bigint gx, floor((y + way * cr * uy) / 2)::bigint gy, count(*) n from un, (select unnest(range(3, 8)) cr), (select unnest([-1, 1]) way) group by 1, 2, 3, 4
      having count(*) >= greatest({float(rings.LEAST_VOTES)}::double, {rings.VOTE_SHARE}::double * 2 * {math.pi}::double * cr))"""


@query(f"""{_VOTES} select map_id, gx * 2 + 1.0::double cx, gy * 2 + 1.0::double cy, cr::double cr from vo a where not exists (
    select 1 from vo b where b.map_id = a.map_id and abs(b.cr - a.cr) <= 1 and abs(b.gx - a.gx) <= 1 and abs(b.gy - a.gy) <= 1 and (-b.n, b.cr, b.gx, b.gy) < (-a.n, a.cr, a.gx, a.gy))""")
def circles_proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate circles by votes along the slopes of a mask."""
    mask = raster(spark, sf_dir).where("m4").select("map_id", "y", "x")
    return rings.proposals(mask, range(3, 8)).select("map_id", "cx", "cy", "cr")


_HATCH = replace(Settings(), hatch_min_holes=1, hatch_min_size_mm=3.0, hatch_open_mm=1.0)
_ENCLOSED = f"""{_spread_sql("m4", _NEXT8)},
    bx as (select map_id, k, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from comp group by map_id, k having max(x) - min(x) >= 2 and max(y) - min(y) >= 2),
    own as (select comp.* from comp join bx using (map_id, k)),
    fr as (select map_id, k, y0, y, unnest(range(x0 - 1, x1 + 2)) x from (select *, unnest(range(y0 - 1, y1 + 2)) y from bx)),
    off as (select fr.* from fr left join own using (map_id, k, y, x) where own.y is null),
    part as (select map_id, k, y, x, y ry, x rx, y0 from off union select b.map_id, b.k, b.y, b.x, t.ry, t.rx, t.y0 from part t join off b on b.map_id = t.map_id and b.k = t.k and abs(b.y - t.y) + abs(b.x - t.x) = 1),
    hp as (select map_id, k, y, x, min((ry + 1) * 1000 + rx + 1) h from part group by map_id, k, y, x, y0 having min(ry) >= y0),
    rim as (select hp.map_id, hp.k, h, count(distinct own.y * 1000 + own.x) around from hp join own on own.map_id = hp.map_id and own.k = hp.k and abs(own.y - hp.y) + abs(own.x - hp.x) = 1 group by 1, 2, 3),
    ho as (select map_id, k, h, count(*) + any_value(around) / 2.0::double - 1 size from hp join rim using (map_id, k, h) group by 1, 2, 3)"""


@query(f"""{_ENCLOSED} select map_id, (k // 1000)::int cy, (k % 1000)::int cx, count(*) holes, round(median(size), 6) median_size, round(sum(size), 6) total_size from ho group by map_id, k""")
def enclosed_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of each large component, with their sizes."""
    found = areas.enclosed(raster(spark, sf_dir).where("m4").select("map_id", "y", "x"), 3)
    per = found.holes.groupBy("map_id").agg(F.count(F.lit(1)).alias("holes"), F.round(F.percentile("size", F.lit(0.5)), 6).alias("median_size"), F.round(F.sum("size"), 6).alias("total_size"))
    return per.select("map_id.map_id", F.col("map_id.comp.y").alias("cy"), F.col("map_id.comp.x").alias("cx"), "holes", "median_size", "total_size")


@query(f"""{_ENCLOSED}, ce as (select * from ho where size between 0.0625::double and 6.25::double), mk as (select map_id, k, greatest(3, round(2 * sqrt(median(size))))::int e from ce group by map_id, k),
    fi as (select map_id, k, y, x from own join mk using (map_id, k) union select map_id, k, y, x from hp join ce using (map_id, k, h)),
    el as (select e, dy, unnest(range(e // 2 - c, least(e // 2 + c + 1, e))) - e // 2 dx from (select e, i - e // 2 dy, round((e // 2) * sqrt(greatest(0.0::double, ((e // 2) * (e // 2) - (i - e // 2) * (i - e // 2)) / ((e // 2) * (e // 2))::double)))::int c from (select e, unnest(range(0, e)) i from (select distinct e from mk)))),
    er as (select fi.map_id, fi.k, fi.y, fi.x, e from fi join mk using (map_id, k) where not exists (select 1 from el left join fi g on g.map_id = fi.map_id and g.k = fi.k and g.y = fi.y + el.dy and g.x = fi.x + el.dx where el.e = mk.e and g.y is null))
    select distinct map_id, (y + dy)::int y, (x + dx)::int x from er join el using (e)""")
def hatch_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with holes of a cell's size, filled and opened by their own ellipse."""
    plane = raster(spark, sf_dir).select("map_id", "y", "x", F.col("m4").alias("purple"))
    return areas.hatched_by_components(plane, 1.0, _HATCH)


@query()
def overprint_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = raster(spark, sf_dir).select("map_id", "y", "x", "label", F.col("m3").alias("purple"))
    return areas.outside_map(areas.hatched(plane, 2.0), 1.0).select("map_id", "y", "x", "hatch", "outside")


_COURSE_LEGS = f"""pts as ({_POINTS}), {_CELL_EDGE},
    q as (select map_id, pid, greatest(0, least(h, floor(py / 4))) r0, greatest(0, least(w, floor(px / 4))) c0 from pts join e using (map_id)),
    spot as (select map_id, pid, (k // 1000 % 1000)::int r, (k % 1000)::int c from (select map_id, pid, min(((r - r0) * (r - r0) + (c - c0) * (c - c0))::bigint * 1000000 + r * 1000 + c) k from q join grid using (map_id) group by map_id, pid)),
    legs as (select map_id, pid from_id, r, c, lead(pid) over w to_id, lead(r) over w er, lead(c) over w ec from spot window w as (partition by map_id order by pid)),
    s0 as (select map_id, from_id::varchar || '>' || to_id leg, r, c from legs where to_id is not null)"""


@query(f"""{_distance_sql(_COURSE_LEGS)}
    select l.map_id, from_id, to_id, d is not null ok, coalesce(round(d * 4, 5), -1.0::double) cost from legs l left join d on d.map_id = l.map_id and d.leg = from_id::varchar || '>' || to_id and d.r = er and d.c = ec where to_id is not null""")
def leg_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A course through all points of each map, routed; paths may differ where costs are equal."""
    grid = written(cells(spark, sf_dir))
    at = written(nearest.snap(points(spark, sf_dir), grid, grid.where(F.col("cost") < INF).select("map_id", "r", "c"), 4).select("map_id", "pid", "r", "c"))
    controls = points(spark, sf_dir).select("map_id", F.col("pid").alias("id"), F.col("pid").alias("order"), F.col("px").alias("x"), F.col("py").alias("y"))
    return routing.legs(controls, grid, at, 4).select("map_id", "from_id", "to_id", "ok", F.round("cost", 5).alias("cost"))


@query(f"""{_RASTER}, p as (select map_id, y, x, {_PALETTE} from m)
    select map_id::varchar "name", y, (max(x) + 1)::int width, '00' || string_agg(format('{{:02X}}{{:02X}}{{:02X}}FF', r, g, b), '' order by x) line from p group by map_id, y""")
def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = raster(spark, sf_dir).withColumn("name", F.col("map_id").cast("string"))
    layer = base.select("name", "y", "x", *[c.alias(n) for n, c in classify.palette(F.col("label")).items()])
    size = base.groupBy("name").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return images.layer_rows(layer, size).select("name", "y", "width", F.hex("line").alias("line"))


@query(f"{_PROFILE}, med as (select map_id, quantile_cont(s, 0.5) q from prof where pr = 6.0 group by map_id) select map_id, pid cid, round(s, 6) support from prof join med using (map_id) where pr = 6.0 and s >= 1.05::double * q")
def relative_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profile(spark, sf_dir).where("radius = 6.0").select("map_id", "cid", "support")
    return rings.relative(found, 1.05).select("map_id", "cid", F.round("support", 6).alias("support"))


@query(f"""{_RASTER}, pts as ({_POINTS}), t as (select map_id, pid own, px + dx * greatest(1.0::double, 0.05::double * pr) px, py + dy * greatest(1.0::double, 0.05::double * pr) py, greatest(1.0::double, pr + dr * greatest(1.0::double, 0.05::double * pr)) pr,
        (dx + 2) * 35 + (dy + 2) * 7 + list_position([-2.0::double, -1, -0.5, 0, 0.5, 1, 2], dr) - 1 n
      from pts, (select unnest([-2, -1, 0, 1, 2]) dx), (select unnest([-2, -1, 0, 1, 2]) dy), (select unnest([-2.0::double, -1, -0.5, 0, 0.5, 1, 2]) dr)),
    c as (select map_id, own * 1000 + n pid, px, py, pr from t), {_ring_sql(_TIGHT, n=36)},
    b as (select map_id, pid, round(avg(hit::int), 9) s from h group by map_id, pid),
    w as (select map_id, own, arg_max(struct_pack(px, py, pr, s), s * 100000 + case when n = 87 then 500 else 0 end - n) x from t join b on b.map_id = t.map_id and b.pid = own * 1000 + n group by t.map_id, own)
    select map_id, own cid, round(x.px, 6) cx, round(x.py, 6) cy, round(x.pr, 6) cr, round(x.s, 6) support from w""".replace("select map_id, own, arg_max", "select t.map_id, own, arg_max"))
def circles_polished(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.polished(_circles(spark, sf_dir), _mask(spark, sf_dir))
    return found.select("map_id", "cid", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cr", "support")])


_FINISH_R0, _FINISH_LEAST = 6.0, 0.1


@query(f"""{_PROFILE.replace("where m3", "where v % 13 = 0")}, p as (select *, pr between {_FINISH_R0} / 6 * 5 * 0.8::double and {_FINISH_R0} / 6 * 5 * 1.2::double wi, pr between {_FINISH_R0} / 6 * 7 * 0.8::double and {_FINISH_R0} / 6 * 7 * 1.2::double wo from prof),
    b as (select map_id, pid, arg_max(pr, s * 1000000 - pr) filter (where wi) ri, max(s) filter (where wi) si, arg_max(pr, s * 1000000 - pr) filter (where wo) ro, max(s) filter (where wo) so from p group by map_id, pid),
    g as (select *, least(si, so) sc from b where ro / ri between 1.4::double * 0.8::double and 1.4::double * 1.2::double and ro - ri >= 0.2::double * {_FINISH_R0} and least(si, so) >= {_FINISH_LEAST})
    select g.map_id, g.pid cid, round(sc, 6) score, ri "inner", ro "outer" from g join p on p.map_id = g.map_id and p.pid = g.pid and p.pr > ri + 1 and p.pr < ro - 1 group by g.map_id, g.pid, sc, ri, ro having min(p.s) <= 0.75::double * sc""")
def finish_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = raster(spark, sf_dir).where("v % 13 = 0").select("map_id", "y", "x")
    found = rings.finish_score(_profile(spark, sf_dir, mask), F.lit(_FINISH_R0), Settings(ring_support_min_ratio=_FINISH_LEAST))
    return found.select("map_id", "cid", F.round("score", 6).alias("score"), "inner", "outer")


@query(f"""{_COLORS}, e as (select map_id, max(y) h, max(x) w from c group by map_id), o as (select dy, dx, exp(-(dy * dy + dx * dx) / 50.0::double) w0 from (select unnest([-2, -1, 0, 1, 2]) dy), (select unnest([-2, -1, 0, 1, 2]) dx) where dy * dy + dx * dx <= 4),
    n as (select c.map_id, c.y, c.x, c.r, c.g, c.b, w0, abs(c.y + dy) ny, abs(c.x + dx) nx, h, e.w from c join e using (map_id), o),
    f as (select n.map_id, n.y, n.x, p.r, p.g, p.b, w0 * exp(-((abs(p.r - n.r) + abs(p.g - n.g) + abs(p.b - n.b))::double * (abs(p.r - n.r) + abs(p.g - n.g) + abs(p.b - n.b))::double) / 1250.0::double) wt
          from n join c p on p.map_id = n.map_id and p.y = case when ny > h then 2 * h - ny else ny end and p.x = case when nx > w then 2 * w - nx else nx end)
    select map_id, y, x, round_even(sum(wt * r) / sum(wt), 0)::int r, round_even(sum(wt * g) / sum(wt), 0)::int g, round_even(sum(wt * b) / sum(wt), 0)::int b from f group by map_id, y, x""")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.bilateral(colors(spark, sf_dir)).select("map_id", "y", "x", "r", "g", "b")


@query(f"""{_RASTER} select a.map_id, a.y, a.x, round(sum(b.v) filter (where b.m3)::double / nullif(count(*) filter (where b.m3), 0), 6) mean
    from m a join m b on a.map_id = b.map_id and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by 1, 2, 3""")
def local_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.window_mean(raster(spark, sf_dir), "v", "m3", 2, "mean").select("map_id", "y", "x", F.round("mean", 6).alias("mean"))


_AXES = f"""{_RASTER}, z as (select map_id, max(y) ey, max(x) ex from m group by map_id), k as (select map_id, y, x from m where v % 16 = 0),
    win as (select k.map_id, k.y, k.x, abs(case when k.y + dy > ey then 2 * ey - k.y - dy else k.y + dy end) qy, abs(case when k.x + dx > ex then 2 * ex - k.x - dx else k.x + dx end) qx from k join z using (map_id), (select unnest(range(-3, 4)) dy), (select unnest(range(-3, 4)) dx)),
    mo as (select w.map_id, w.y, w.x, count(*) n, sum(qx - w.x) sx, sum(qy - w.y) sy, sum((qx - w.x) * (qx - w.x)) xx, sum((qy - w.y) * (qy - w.y)) yy, sum((qx - w.x) * (qy - w.y)) xy from win w join k on k.map_id = w.map_id and k.y = qy and k.x = qx group by 1, 2, 3),
    ax as (select map_id, y, x, 0.5::double * atan2((2 * (n * xy - sx * sy))::double, ((n * xx - sx * sx) - (n * yy - sy * sy))::double) t from mo)"""


@query(f"""{_AXES},
    li as (select map_id, y, x, (((v % 100) + 100) % 100)::double l from m),
    sp as (select map_id, y, x, i, least(greatest(y + cos(t) * (i * 0.25::double - 4), 0), ey) sy, least(greatest(x - sin(t) * (i * 0.25::double - 4), 0), ex) sx, ey, ex from ax join z using (map_id), (select unnest(range(0, 33)) i)),
    co as (select map_id, y, x, i, floor(sy + 0.0::double)::int y0, floor(sx + 0.0::double)::int x0, least(floor(sy)::int + 1, ey) y1, least(floor(sx)::int + 1, ex) x1, sy - floor(sy) fy, sx - floor(sx) fx from sp),
    va as (select co.map_id, co.y, co.x, i, round(a.l * (1 - fy) * (1 - fx) + b.l * (1 - fy) * fx + c.l * fy * (1 - fx) + d.l * fy * fx, 6) p from co
           join li a on a.map_id = co.map_id and a.y = y0 and a.x = x0 join li b on b.map_id = co.map_id and b.y = y0 and b.x = x1
           join li c on c.map_id = co.map_id and c.y = y1 and c.x = x0 join li d on d.map_id = co.map_id and d.y = y1 and d.x = x1),
    gr as (select map_id, y, x, min(p) filter (where i between 14 and 18) line, greatest(max(p) filter (where i < 4), max(p) filter (where i > 28)) ground from va group by 1, 2, 3),
    br as (select map_id, y, x, line, ground, coalesce(max(i) filter (where i <= 16 and p > round((line + ground) / 2, 6)), -1) l, coalesce(min(i) filter (where i >= 16 and p > round((line + ground) / 2, 6)), 33) r from va join gr using (map_id, y, x) group by 1, 2, 3, 4, 5)
    select map_id, y, x, case when l < 16 and ground - line > 10 then (r - l - 1) * 0.25::double else 0 end width from br""")
def stroke_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths at half depth across the local axis of a thin mask's pixels, on a plane of values as lightness."""
    plane = written(raster(spark, sf_dir).select("map_id", "y", "x", "v", F.pmod("v", F.lit(100)).cast("double").alias("l")))
    return lines.profile_widths(plane.where("v % 16 = 0"), plane)


@query(f"""{_RASTER}, z as (select map_id, max(y) ey, max(x) ex from m group by map_id), o as (select unnest(range(-5, 6)) d),
    g as (select m.map_id, m.y, m.x, abs(case when m.y + a.d > ey then 2 * ey - m.y - a.d else m.y + a.d end) qy, abs(case when m.x + b.d > ex then 2 * ex - m.x - b.d else m.x + b.d end) qx from m join z using (map_id), o a, o b where m.m4)
    select g.map_id, g.y, g.x, round(avg((m.v % 9 + 9) % 9), 6) mean, count(*) n from g join m on m.map_id = g.map_id and m.y = qy and m.x = qx where m.m3 and m.v % 9 <> 0 group by 1, 2, 3
    having round(avg((m.v % 9 + 9) % 9), 6) >= 4.5::double and count(*) >= 4""")
def mirrored_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of measured pixels around each pixel of a mask, the border mirrored, where they are large and enough."""
    plane = raster(spark, sf_dir).withColumns({"width": F.pmod("v", F.lit(9)), "ok": F.col("m3") & (F.col("v") % 9 != 0)})
    found = stencil.window_mean(plane, "width", "ok", 5, "mean", "n", stencil.extent(plane)).where("m4").withColumn("mean", F.round("mean", 6))
    return found.where("mean >= 4.5 and n >= 4").select("map_id", "y", "x", "mean", "n")


_PARTS = f"""pt as ({_POINTS}), part as (select map_id, pid part, (pid % 5)::bigint area, px::int x0, py::int y0, (px + pr)::int x1, (py + 1 + pid % 7)::int y1, (1 + pid % 7)::int h from pt)"""


@query(f"""with recursive {_PARTS}, fit as (select * from part where area >= 3 and greatest(x1 - x0, y1 - y0) <= 15),
    e as (select a.map_id, a.part p, b.part q from fit a join fit b on a.map_id = b.map_id and a.part <> b.part and greatest(a.h, b.h) >= 2.4::double
          and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.4::double * least(a.h, b.h) and greatest(b.x0 - a.x1, a.x0 - b.x1) <= 0.45::double * greatest(a.h, b.h)),
    t as (select map_id, part p, part q from fit union select t.map_id, t.p, e.q from t join e on e.map_id = t.map_id and e.p = t.q),
    g as (select map_id, p, min(q) line from t group by map_id, p)
    select g.map_id, line, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, count(*) n from g join fit s on s.map_id = g.map_id and s.part = g.p group by g.map_id, line having max(h) >= 3""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, i = F.col("px").cast("int"), F.col("py").cast("int"), F.col("pid")
    parts = points(spark, sf_dir).select("map_id", i.alias("part"), (i % 5).alias("area"), x.alias("x0"), y.alias("y0"), (x + F.col("pr").cast("int")).alias("x1"), (y + 1 + (i % 7).cast("int")).alias("y1"))
    return course.text_lines(parts, F.lit(6.0)).select("map_id", "line", "x0", "y0", "x1", "y1", "n")


@query(f"""with q as (select user_id map_id, event_id edit_id, case event_type when 'click' then 'forbid' when 'view' then 'allow' else 'other' end kind from events)
    select map_id, count(*) filter (where kind = 'forbid') n_forbid, count(*) filter (where kind = 'allow') n_allow from q group by map_id""")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "forbid").when(F.col("event_type") == "view", "allow").otherwise("other")
    return terrain.edit_counts(_table(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), kind.alias("kind")))


@query("""with l as (select user_id map_id, event_id % 3 <> 0 ok, value length_m from events)
    select map_id, round(coalesce(sum(length_m) filter (where ok), 0.0::double), 4) length_m, count(*) filter (where ok) n_ok, count(*) filter (where not ok) n_unreachable from l group by map_id""")
def leg_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = _table(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), (F.col("event_id") % 3 != 0).alias("ok"), F.col("value").alias("length_m"))
    return routing.leg_totals(legs).withColumn("length_m", F.round("length_m", 4))


@query("""select event_id, round(value * (scale / 1000.0::double / ppm), 6) length_m from (select *, 1000 + event_id % 7000 scale, 2.0::double + event_id % 9 ppm from events) where scale = 4000 or true""".replace("1000 + event_id % 7000 scale, 2.0::double + event_id % 9 ppm", "7500 scale, 3.5::double ppm").replace(" where scale = 4000 or true", ""))
def legs_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = _table(spark, sf_dir, "events").select("event_id", F.col("value").alias("length_px"))
    return routing.rescaled(legs, 7500, 3.5).select("event_id", F.round("length_m", 6).alias("length_m"))


_BOXES = "select event_id, (event_id * 7 % 1300 - 100)::int a, (event_id * 13 % 900 - 50)::int b, (event_id * 11 % 1300 - 100)::int c, (event_id * 17 % 900 - 50)::int d from events"


@query(f"""with q as ({_BOXES}), k as (select event_id, greatest(0, least(1100, least(a, c))) x0, greatest(0, least(800, least(b, d))) y0, greatest(0, least(1100, greatest(a, c))) x1, greatest(0, least(800, greatest(b, d))) y1 from q)
    select * from k where x1 - x0 >= 10 and y1 - y0 >= 10""")
def crops_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops drawn in any direction, inside their picture; those too small would fail, so they are left out first."""
    i = F.col("event_id")
    drawn = _table(spark, sf_dir, "events").select("event_id", *[(i * a % m - b).cast("int").alias(n) for n, a, m, b in (("x0", 7, 1300, 100), ("y0", 13, 900, 50), ("x1", 11, 1300, 100), ("y1", 17, 900, 50))], F.lit(1100).alias("width"), F.lit(800).alias("height"))
    sized = drawn.select("event_id", *[F.greatest(F.lit(0), F.least(F.col(c), F.lit(m))).alias(c) for c, m in (("x0", 1100), ("x1", 1100), ("y0", 800), ("y1", 800))])
    large = sized.where((F.abs(F.col("x1") - F.col("x0")) >= 10) & (F.abs(F.col("y1") - F.col("y0")) >= 10)).select("event_id")
    return projects.clamped_crop(written(drawn.join(large, "event_id", "left_semi"))).select("event_id", "x0", "y0", "x1", "y1")


@query("""with q as (select event_id, case when event_id % 4 = 0 then (event_id % 40)::double end r0, (event_id % 9000 - 5)::int scale, case when event_id % 3 = 0 then 0.0::double end x1, 0.0::double y1, case when event_id % 6 = 0 then (event_id % 50)::double end x2, 3.0::double y2, case when event_id % 3 = 0 then value end meters, case when event_id % 5 <> 0 then 5.0::double end px_per_mm from events),
    p as (select *, case when r0 > 1 then 2 * r0 / 6.0::double else coalesce(px_per_mm, 6.0::double) end ppm, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) dist, x1 is not null or x2 is not null or meters is not null any_given from q),
    f as (select *, coalesce(x1 is not null and x2 is not null and meters > 0 and dist >= 1, false) is_full from p)
    select event_id, ppm px_per_mm, (case when is_full then greatest(1, round_even(meters / dist * ppm * 1000, 0)::int) else scale end)::int scale,
      case when r0 <= 1 then 'radius is too small' when any_given and not is_full then 'measurement is incomplete' when not any_given and scale < 1 then 'scale is not positive' end problem from f""")
def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    asked = _table(spark, sf_dir, "events").select(
        "event_id", F.when(i % 4 == 0, (i % 40).cast("double")).alias("r0"), (i % 9000 - 5).cast("int").alias("scale"), F.when(i % 3 == 0, 0.0).alias("x1"), F.lit(0.0).alias("y1"),
        F.when(i % 6 == 0, (i % 50).cast("double")).alias("x2"), F.lit(3.0).alias("y2"), F.when(i % 3 == 0, F.col("value")).alias("meters"), F.when(i % 5 != 0, 5.0).alias("px_per_mm"),
    )
    return projects.calibrated(asked).select("event_id", "px_per_mm", "scale", "problem")


@query("select user_id project_id, max(event_id) \"version\", row_number() over (order by arg_max(ts, event_id) desc, user_id) place from events group by user_id")
def projects_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by last change; the place is numbered here so that the order shows in the result."""
    versions = _table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("version"), F.col("ts").alias("modified"))
    newest = projects.listed(versions)
    return newest.select("project_id", "version", F.row_number().over(Window.orderBy(F.desc("modified"), "project_id")).cast("long").alias("place"))


@query("select user_id, round(sum(value), 4) total from events group by user_id")
def stage_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's result by the key of what it depends on: made at the first call, read at the second."""
    sums = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    key = spark.range(1).select(projects.stage_key(F.lit(sf_dir).alias("input"), F.lit("sums").alias("stage"))).first()[0]
    base = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    projects.stored(spark, base, key, lambda: sums)
    return projects.stored(spark, base, key, lambda: sums.limit(0))


@query("select user_id map_id, round(sum(value), 4) total, (case when user_id % 2 = 0 then 1 else 2 end)::int made from events group by user_id")
def stages_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage kept for each user: half are made by a first call; a second one, for all, makes the others only."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), "event_id", "value")
    store = stages.Store(spark, f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}")

    def totals(rows: DataFrame, call: int) -> DataFrame:
        keys = stages.next_keys(stages.content_keys(rows, "event_id", "value"), "totals", {"digits": 4})
        return store.result("totals", keys, lambda maps: rows.join(maps, "map_id", "left_semi").groupBy("map_id").agg(F.round(F.sum("value"), 4).alias("total"), F.lit(call).alias("made")))

    totals(events.where("map_id % 2 = 0"), 1)
    return totals(events, 2)


@query(f"{_RASTER} select map_id, y, x, {_PALETTE} from m")
def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers rendered to PNG files and read again as pixels."""
    base = raster(spark, sf_dir).withColumn("name", F.concat(F.lit("map-"), F.col("map_id")))
    layer = base.select("name", "y", "x", *[c.alias(n) for n, c in classify.palette(F.col("label")).items()])
    size = base.groupBy("name").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    folder = f"{shared_dir(spark)}/pictures-{uuid.uuid4().hex}"
    images.write_pngs(images.png_files(layer, size), folder)
    name = r"(map-\d+)\.png$"
    found = images.scan_files(spark, folder).select(F.regexp_extract("path", name, 1).alias("scan"))
    pixels = images.read_pixels(spark, folder).join(found, F.regexp_extract("origin", name, 1) == F.col("scan"))
    return pixels.select(F.regexp_extract("origin", r"map-(\d+)", 1).cast("int").alias("map_id"), "y", F.col("x").cast("int").alias("x"), "r", "g", "b")


@query(f"""{_RASTER}, z as (select map_id, max(y) + 1 h, max(x) + 1 w from m group by map_id)
    select 'map-' || map_id as name, 'taken' as told, w::int width, h::int height from z union all select 'map-' || map_id || '-cut', 'could not be decoded', null, null from z
    union all select 'map-' || map_id || '-text', 'could not be decoded', null, null from z""")
def pictures_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered pictures, the same cut in half, text under a picture's name: what is taken and what is told apart."""
    base = raster(spark, sf_dir).withColumn("name", F.concat(F.lit("map-"), F.col("map_id")))
    layer = base.select("name", "y", "x", *[c.alias(n) for n, c in classify.palette(F.col("label")).items()])
    files = written(images.png_files(layer, base.groupBy("name").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))))
    variants = {"": F.col("content"), "-cut": F.substring("content", F.lit(1), (F.length("content") / 2).cast("int")), "-text": F.col("name").cast("binary")}
    every = files.select(F.explode(F.array(*[F.struct(F.concat("name", F.lit(n)).alias("name"), c.alias("content")) for n, c in variants.items()])).alias("f")).select("f.*")
    folder = f"{shared_dir(spark)}/scans-{uuid.uuid4().hex}"
    images.write_pngs(every, folder)
    good, bad = images.ingested(spark, folder)
    name = F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name")
    return good.select(name, F.lit("taken").alias("told"), "width", "height").union(bad.select(name, "reason", F.lit(None).cast("int"), F.lit(None).cast("int")))


@query("""select case when event_id % 5 = 0 then 'malformed document' when event_id % 7 = 0 then 'no project id' when event_id % 11 = 0 then 'no version' else 'taken' end told, count(*) n, max(event_id) last from events group by 1""")
def documents_told_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project documents of which some are cut off, have no id or no version."""
    whole = F.to_json(F.struct(F.when(F.col("event_id") % 7 == 0, "?").otherwise(F.substring(F.md5(F.col("user_id").cast("string")), 1, 12)).alias("project_id"), F.when(F.col("event_id") % 11 != 0, F.col("event_id")).alias("version"), F.concat(F.lit("map "), F.col("user_id")).alias("name")))
    body = F.when(F.col("event_id") % 5 == 0, F.substring(whole, F.lit(1), (F.length(whole) / 2).cast("int"))).otherwise(whole)
    made = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), "event_id", body.alias("body"))
    good, bad = projects.documents(made.select("path", "body"))
    every = good.select(F.lit("taken").alias("told"), F.col("version").alias("event_id")).union(bad.select("reason", F.col("path").cast("long")))
    return every.groupBy("told").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


_NODES = "n as (select distinct l_suppkey::int map_id, l_linenumber::int node, case l_linenumber when 1 then 'start' when 7 then 'finish' else 'control' end kind from lineitem)"
_LINES = f"""{_NODES}, s as (select a.map_id, a.node i, b.node j, ((a.map_id * 31 + a.node * b.node * (a.node + 2 * b.node) * 37) * 7919 % 9973) / 9973.0::double support from n a join n b on a.map_id = b.map_id and a.node < b.node),
    e as (select map_id, i, j, support from s union all select map_id, j, i, support from s)"""


def _course(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seven course symbols a supplier, and made-up line support of their pairs."""
    node = F.col("l_linenumber").cast("int")
    nodes = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("int").alias("map_id"), node.alias("node"), F.when(node == 1, "start").when(node == 7, "finish").otherwise("control").alias("kind")).distinct()
    a, b = nodes.select("map_id", F.col("node").alias("i")), nodes.select("map_id", F.col("node").alias("j"))
    # In long: the product passes the range of int from supplier 8744 on.
    strength = ((F.col("map_id").cast("long") * 31 + F.col("i") * F.col("j") * (F.col("i") + 2 * F.col("j")) * 37) * 7919 % 9973) / 9973.0
    return nodes, a.join(b, "map_id").where("i < j").withColumn("support", strength)


@query(f"""with recursive {_LINES}, rk as (select *, row_number() over (partition by map_id, i order by support desc, j) rank from e), h as (select unnest([1.0::double, 0.75, 0.5]) share), k as (select map_id, count(*) k, max(node) filter (where kind = 'finish') f, max(node) filter (where kind = 'start') st from n group by map_id),
    t as (select k.map_id, share, [st] path, []::bigint[] ranks from k, h where st is not null
      union all select t.map_id, share, list_append(path, e.j), list_append(ranks, e.rank) from t join rk e on e.map_id = t.map_id and e.i = path[-1] and e.support >= 0.6::double * share and not list_contains(path, e.j) join k on k.map_id = t.map_id where e.j is distinct from k.f or len(path) = k.k - 1),
    whole as (select t.map_id, arg_min(path, {{'weak': -share, 'ranks': ranks}}) path from t join k on k.map_id = t.map_id where len(path) = k.k and (f is null or path[-1] = f) group by t.map_id)
    select map_id, array_to_string(path, ',') path from whole""")
def courses_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete courses along supported lines, of several the first by falling strength of its lines."""
    nodes, support = _course(spark, sf_dir)
    found = course.ordered_by_lines(nodes, support).where("complete")
    return found.select("map_id", F.array_join(F.col("order").cast("array<string>"), ",").alias("path"))


@query(f"""with recursive {_LINES}, lab as (select map_id, node, node - 1 num from n where kind = 'control' and (map_id + node) % 4 <> 0), ctl as (select map_id, count(*) n, list(node order by node) nodes from n where kind = 'control' group by map_id),
    rd as (select map_id, list(num) nums, list(node) told, max(num) top from lab where num <= (select c.n from ctl c where c.map_id = lab.map_id) group by map_id),
    f as (select map_id, list_filter(nodes, lambda x: not list_contains(told, x)) free, nums, told, top from rd join ctl using (map_id)),
    g as (select *, greatest(top, len(nums) + len(free)) total from f),
    mi as (select *, list_filter(range(1, total + 1), lambda x: not list_contains(nums, x)) missing from g),
    ok as (select * from mi where len(missing) = 0 or len(missing) = len(free) and len(missing) <= 3),
    w as (select map_id, []::int[] way from ok union all select w.map_id, list_append(way, u) from w join (select map_id, missing, unnest(free) u from ok) o on o.map_id = w.map_id where len(way) < len(missing) and not list_contains(way, u)),
    fw as (select w.map_id, way, missing, nums, told, total from w join ok using (map_id) where len(way) = len(missing)),
    seq as (select map_id, way, unnest(range(1, total + 1)) v, missing, nums, told from fw),
    st as (select map_id, way, v, case when list_contains(missing, v) then way[list_position(missing, v)] else told[list_position(nums, v)] end node, list_contains(missing, v) filled from seq
      union all select fw.map_id, way, case kind when 'start' then 0 else 1000 end, node, false from fw join n on n.map_id = fw.map_id and kind <> 'control'),
    nx as (select *, lead(node) over z t, lead(filled) over z tf from st window z as (partition by map_id, way order by v)),
    sc as (select nx.map_id, way, round(sum(case when t is not null then coalesce(support, 0.0::double) end), 9) score, min(case when t is not null and (filled or tf) then coalesce(support, 0.0::double) end) weakest, string_agg(node::varchar, ',' order by v) path from nx left join s on s.map_id = nx.map_id and s.i = least(node, t) and s.j = greatest(node, t) group by nx.map_id, way),
    best as (select *, row_number() over (partition by map_id order by score desc, way) z from sc)
    select map_id, path from best where z = 1 and coalesce(weakest, 1) >= 0.3""")
def courses_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses from printed numbers, of which some could not be read."""
    nodes, support = _course(spark, sf_dir)
    labels = nodes.where("kind = 'control' and (map_id + node) % 4 <> 0").select("map_id", "node", F.array(F.col("node") - 1).alias("orders"))
    found = course.ordered_by_labels(nodes, labels, support).where("order is not null")
    return found.select("map_id", F.array_join(F.col("order").cast("array<string>"), ",").alias("path"))


@query("""with e as (select user_id map_id, (event_id % 6)::int node, row_number() over (partition by user_id order by ts, event_id) - 1 pos from events),
    v as (select *, row_number() over (partition by map_id, node order by pos) nth from e), x as (select *, sum((nth > 1)::int) over (partition by map_id order by pos) more from v),
    n as (select distinct user_id map_id, unnest(range(0, 8))::int node from events)
    select n.map_id, (case when pos is null or nth = 1 then node else 7 + more end)::int id, pos::int ord from n left join x using (map_id, node)""")
def course_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of courses that come by some symbols again and leave others out."""
    events = _table(spark, sf_dir, "events")
    nodes = events.select(F.col("user_id").alias("map_id")).distinct().withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("map_id", "node", F.lit("control").alias("kind"), *[F.lit(0.0).alias(c) for c in "xyr"])
    order = events.groupBy(F.col("user_id").alias("map_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda e: (e["event_id"] % 6).cast("int")).alias("order"))
    return course.visits(nodes, order).select("map_id", F.col("id").cast("int").alias("id"), F.col("order").alias("ord"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("pid") % 3 == 0, "start").when(F.col("pid") % 3 == 1, "control").otherwise("finish")
    return points(spark, sf_dir).select("map_id", F.col("pid").alias("node"), kind.alias("kind"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pr").alias("r"))


@query(f"""{_RASTER}, c as (select *, case pid % 3 when 0 then 'start' when 1 then 'control' else 'finish' end kind from ({_POINTS})),
    d as (select m.map_id, m.y, m.x, c.*, sqrt((m.x - round_even(px, 0)) * (m.x - round_even(px, 0)) + (m.y - round_even(py, 0)) * (m.y - round_even(py, 0))) d from m join c on c.map_id = m.map_id where m.m3),
    gone as (select distinct map_id, y, x from d where kind = 'start' and d <= round_even(1.1::double * pr, 0) or kind <> 'start' and abs(d - round_even(pr, 0)) <= 1.5 or kind = 'finish' and abs(d - round_even(pr * 5 / 7, 0)) <= 1.5)
    select m.map_id, m.y, m.x from m where m3 and not exists (select 1 from gone g where g.map_id = m.map_id and g.y = m.y and g.x = m.x)""".replace("select m.map_id, m.y, m.x, c.*,", "select m.map_id, m.y, m.x, pr, kind,"))
def symbols_erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.erased(_mask(spark, sf_dir), _symbols(spark, sf_dir), F.lit(6.0)).select("map_id", "y", "x")


@query(f"""{_RASTER}, {_PAIRS}, c as (select *, case pid % 3 when 0 then 'start' when 1 then 'control' else 'finish' end kind from ({_POINTS})),
    d as (select m.map_id, m.y, m.x, pr, kind, sqrt((m.x - round_even(px, 0)) * (m.x - round_even(px, 0)) + (m.y - round_even(py, 0)) * (m.y - round_even(py, 0))) d from m join c on c.map_id = m.map_id where m.m3),
    le as (select *, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) d from pairs where i % 5 = 0),
    en as (select map_id, round_even(ax + (bx - ax) / d * ar, 0) ax, round_even(ay + ("by" - ay) / d * ar, 0) ay, round_even(bx - (bx - ax) / d * br, 0) bx, round_even("by" - ("by" - ay) / d * br, 0) b_y from le where d > 0),
    pr as (select m.map_id, m.y, m.x, ax, ay, bx - ax vx, b_y - ay vy, case when bx = ax and b_y = ay then 0 else greatest(0, least(1, ((m.x - ax) * (bx - ax) + (m.y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) end t from m join en on en.map_id = m.map_id where m.m3),
    gone as (select distinct map_id, y, x from d where kind = 'start' and d <= round_even(1.1::double * pr, 0) or kind = 'control' and abs(d - round_even(pr, 0)) <= 2.5 or kind = 'finish' and (abs(d - round_even(pr, 0)) <= 1.5 or abs(d - round_even(pr * 5 / 7, 0)) <= 1.5)
      union select map_id, y, x from pr where (x - ax - t * vx) * (x - ax - t * vx) + (y - ay - t * vy) * (y - ay - t * vy) <= 2.25 + 1e-9)
    select m.map_id, m.y, m.x from m where m3 and not exists (select 1 from gone g where g.map_id = m.map_id and g.y = m.y and g.x = m.x)""")
def text_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask without symbols and without every fifth leg between them, at a scale where rings around text are wider."""
    legs = _pairs(spark, sf_dir).where("i % 5 = 0")
    return course.text_ink(_mask(spark, sf_dir), _symbols(spark, sf_dir), legs, F.lit(12.0)).select("map_id", "y", "x")


@query(f"""with s as (select user_id map_id, case when event_id % 9 = 0 then null when event_id % 4 = 0 then event_type else lower(({CLASS_NAMES})[event_id % {len(CLASS_NAMES)} + 1]) end n from events), t as (select map_id, n, coalesce(list_position({CLASS_NAMES[:-1]}, upper(n)), 0)::int k from s)
    select map_id, case when k > 0 then upper(n) else n end class_name, (k - 1)::int class_id, count(*) n, case when k = 0 then 'unknown class' end reason from t group by all""")
def samples_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked points by class, in upper case, and names that are no class with the reason."""
    names = F.element_at(F.array(*map(F.lit, CLASS_NAMES)), (F.col("event_id") % len(CLASS_NAMES) + 1).cast("int"))
    name = F.when(F.col("event_id") % 9 != 0, F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.lower(names)))
    clicks = _table(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), name.alias("class_name"), F.col("event_id").alias("sx"), F.lit(0).alias("sy"))
    good, bad = classify.checked_samples(clicks)
    counted = good.groupBy("map_id", "class_name", "class_id").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit(None).cast("string"))
    return counted.unionByName(bad.withColumn("class_id", F.lit(-1))).select("map_id", "class_name", F.col("class_id").cast("int").alias("class_id"), "n", "reason")
