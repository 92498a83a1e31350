"""Forbidden ground, user edits and the cost grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartospark.operators.classify import fine_cost
from kartospark.operators.stencil import close_diagonals, dilate, opened_by
from kartospark.settings import BLACK, BLUE, GREY, OLIVE, Settings
from kartospark.sources.shared import written

INF = float("inf")


def cell_size(px_per_mm: float, cfg: Settings | None = None) -> int:
    """Pixels a side of a cost cell, rounded half to even."""
    return max(1, round((cfg or Settings()).cell_mm * px_per_mm))


def inside_polygon(x: Column, y: Column, points: Column) -> Column:
    """Whether a pixel is inside a polygon (array of ``(x, y)`` integers) or on its outline.

    Even-odd crossings of the ray to the right, and for the outline collinear points
    within an edge's box.
    """
    n = F.size(points)

    def edge(i: Column) -> tuple[Column, Column, Column, Column]:
        a, b = F.element_at(points, i + 1), F.element_at(points, (i + 1) % n + 1)
        return a["x"], a["y"], b["x"], b["y"]

    def crosses(i: Column) -> Column:
        ax, ay, bx, by = edge(i)
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        return ((ay > y) != (by > y)) & F.when(by > ay, side > 0).otherwise(side < 0)

    def on(i: Column) -> Column:
        ax, ay, bx, by = edge(i)
        flat = (bx - ax) * (y - ay) == (x - ax) * (by - ay)
        return flat & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    every = F.sequence(F.lit(0), n - 1)
    return F.exists(every, on) | (F.size(F.filter(every, crosses)) % 2 == 1)


def polygon_pixels(pixels: DataFrame, edits: DataFrame, origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """``(map_id, edit_id, kind, y, x)`` of pixels in edit polygons.

    ``edits`` is ``(map_id, edit_id, kind, points)``; vertices are moved by the crop's
    origin and rounded half to even; polygons of fewer than three points are ignored.
    Rows of the bounding box meet pixels by an equi-join on the row, so a small edit
    touches few rows.
    """
    shift = F.transform("points", lambda p: F.struct((F.rint(p["x"] - origin[0])).cast("long").alias("x"), F.rint(p["y"] - origin[1]).cast("long").alias("y")))
    good = edits.where(F.size("points") >= 3).withColumn("points", shift)
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    rows = good.select("map_id", "edit_id", "kind", "points", F.array_min(xs).alias("__x0"), F.array_max(xs).alias("__x1"), F.explode(F.sequence(F.array_min(ys), F.array_max(ys))).alias("y"))
    met = pixels.select("map_id", "y", "x").join(rows, ["map_id", "y"]).where("x between __x0 and __x1")
    return met.where(inside_polygon(F.col("x"), F.col("y"), F.col("points"))).select("map_id", "edit_id", "kind", "y", "x")


def edit_counts(edits: DataFrame) -> DataFrame:
    """``(map_id, n_forbid, n_allow)``: edits of each map by kind."""
    return edits.groupBy("map_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("forbid", "allow")])


def apply_edits(plane: DataFrame, masks: DataFrame, columns: list[str]) -> DataFrame:
    """Forbid polygons are added to the first column; allow polygons, last, clear all columns."""
    said = masks.groupBy("map_id", "y", "x").agg(F.bool_or(F.col("kind") == "forbid").alias("__f"), F.bool_or(F.col("kind") == "allow").alias("__a"))
    joined = plane.join(said, ["map_id", "y", "x"], "left")
    forbid, allow = F.coalesce("__f", F.lit(False)), F.coalesce("__a", F.lit(False))
    new = {c: ((F.col(c) | forbid) if i == 0 else F.col(c)) & ~allow for i, c in enumerate(columns)}
    return joined.withColumns(new).drop("__f", "__a")


def buildings(plane: DataFrame, px_per_mm: float, cfg: Settings | None = None) -> DataFrame:
    """Adds ``building``: grey areas that an ellipse of the least building width fits into."""
    k = max(3, round((cfg or Settings()).building_min_width_mm * px_per_mm))
    return opened_by(plane.withColumn("__grey", F.col("label") == GREY), "__grey", k, "building").drop("__grey")


def outlines(plane: DataFrame, px: int = 1) -> DataFrame:
    """Adds ``outline``: black within ``px`` of a building."""
    return dilate(plane, "building", px, "__near").withColumn("outline", F.col("__near") & (F.col("label") == BLACK)).drop("__near")


def water(plane: DataFrame, px_per_mm: float, cfg: Settings | None = None) -> DataFrame:
    """Adds ``water``: blue areas, without thin lines such as north lines."""
    k = max(3, round((cfg or Settings()).water_min_width_mm * px_per_mm))
    return opened_by(plane.withColumn("__blue", F.col("label") == BLUE), "__blue", k, "water").drop("__blue")


def forbidden() -> Column:
    """Grey and olive ground, hatching, paper outside the map, building outlines, water and barriers."""
    return (F.col("label") == GREY) | (F.col("label") == OLIVE) | F.col("hatch") | F.col("outside") | F.col("outline") | F.col("water") | F.col("barrier")


def cost_cells(plane: DataFrame, cell_px: int, cfg: Settings | None = None) -> DataFrame:
    """``(map_id, r, c, cost, barrier)`` from pixels ``(map_id, y, x, label, forbidden, barrier)``.

    A cell costs the mean of its passable pixels. It is forbidden, at infinite cost, if
    all its pixels are or any is a barrier; moves between diagonal neighbours of such
    cells are closed too.
    """
    free = ~F.col("forbidden")
    cells = plane.groupBy("map_id", F.floor(F.col("y") / cell_px).cast("int").alias("r"), F.floor(F.col("x") / cell_px).cast("int").alias("c")).agg(
        F.avg(F.when(free, fine_cost(F.col("label"), cfg))).alias("mean"), F.bool_or(F.col("barrier")).alias("barrier")
    )
    shut = cells.withColumn("shut", F.col("barrier") | F.col("mean").isNull())
    dense = shut.withColumnsRenamed({"r": "y", "c": "x"})
    closed = close_diagonals(dense, "shut", "closed").withColumnsRenamed({"y": "r", "x": "c"})
    return closed.select("map_id", "r", "c", F.when(F.col("closed"), F.lit(INF)).otherwise(F.col("mean")).alias("cost"), "barrier")


def edited_cells(planes: DataFrame, cells: DataFrame, before: DataFrame, after: DataFrame, cell_px: int, cfg: Settings | None = None, origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """``cells`` of ``planes`` under the edits ``before``, brought to the edits ``after``: equal to a full run, but made of few pixels.

    Edits ``(map_id, edit_id, kind, points)`` that only one side has make the cells that
    their boxes cover dirty. A cell can also be closed or opened by one beside it, so
    those around dirty ones are made anew too, from the pixels of one more cell around.
    Only rows of pixels between the first and the last of these are read.
    """
    columns = ["map_id", "edit_id", "kind", "points"]
    a, b = before.select(columns), after.select(columns)
    changed = a.subtract(b).union(b.subtract(a)).where(F.size("points") >= 3)

    def span(axis: str, start: int) -> Column:
        values = F.transform("points", lambda p: F.floor((F.rint(p[axis]) - start) / cell_px).cast("int"))
        return F.sequence(F.array_min(values) - 2, F.array_max(values) + 2)

    boxes = changed.select("map_id", span("y", origin[1]).alias("rs"), span("x", origin[0]).alias("cs"))
    inner = F.col("i").between(1, F.size("rs") - 2) & F.col("j").between(1, F.size("cs") - 2)
    blocks = boxes.select("map_id", "rs", "cs", F.posexplode("rs").alias("i", "r")).select("map_id", "rs", "cs", "i", "r", F.posexplode("cs").alias("j", "c"))
    needed = written(blocks.groupBy("map_id", "r", "c").agg(F.bool_or(inner).alias("anew")))
    low, high = needed.agg(F.min("r"), F.max("r")).first()
    if low is None:
        return cells
    here = planes.where(F.col("y").between(low * cell_px, (high + 1) * cell_px - 1)).withColumns({"__r": F.floor(F.col("y") / cell_px).cast("int"), "__c": F.floor(F.col("x") / cell_px).cast("int")})
    asked = needed.select("map_id", F.col("r").alias("__r"), F.col("c").alias("__c"))
    pixels = written(here.join(asked, ["map_id", "__r", "__c"], "left_semi").drop("__r", "__c"))
    made = cost_cells(apply_edits(pixels, polygon_pixels(pixels, after, origin), ["forbidden", "barrier"]), cell_px, cfg)
    anew = needed.where("anew").select("map_id", "r", "c")
    return cells.join(anew, ["map_id", "r", "c"], "left_anti").unionByName(made.join(anew, ["map_id", "r", "c"], "left_semi"))
