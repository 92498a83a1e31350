"""Nearest set pixel of a mask, exactly, in two passes of linear work.

First each pixel learns the nearest set pixel of its column, by windows. Then each row of
a map, a group as wide as the map, is one lower envelope of parabolas (Felzenszwalb and
Huttenlocher 2012), of which every pixel reads its nearest column.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def nearest_along(sites: list[tuple[int, int, int]], asked: list[int]) -> list[tuple[int, int, int]]:
    """``(d2, row, x)`` of the nearest site for each place in ``asked``, in order; ties go by ``(d2, row, x)``.

    A site ``(x, g, row)`` stands for a pixel ``g`` rows away in column ``x``: a parabola
    over the row of pixels. Sites come by ``x``, and so do the places; the parabolas that
    are lowest somewhere, if only level with others, are kept in one pass, so work is
    linear. Where one takes over from the last is a fraction, compared exactly.
    """
    kept: list[tuple[int, int, int]] = []
    start: list[tuple[int, int]] = []
    for x, g, row in sites:
        while True:
            if not kept:
                from_ = (-1, 0)
                break
            x0, g0, _ = kept[-1]
            from_ = (g * g + x * x - g0 * g0 - x0 * x0, 2 * (x - x0))
            if len(kept) == 1 or from_[0] * start[-1][1] >= start[-1][0] * from_[1]:
                break
            kept.pop()
            start.pop()
        kept.append((x, g, row))
        start.append(from_)
    out, k = [], 0
    for x in asked:
        while k + 1 < len(kept) and start[k + 1][0] < x * start[k + 1][1]:
            k += 1
        last = k
        while last + 1 < len(kept) and start[last + 1][0] == x * start[last + 1][1]:
            last += 1
        out.append(min(((x - x0) ** 2 + g * g, row, x0) for x0, g, row in kept[k : last + 1]))
    return out


def _nearest_in_row(key: tuple, rows: pa.Table) -> pa.Table:
    """One row of one map: where its wanted pixels find the nearest target."""
    rows = rows.sort_by("x")
    x, g, cy, wanted = (rows.column(c).to_pylist() for c in ("x", "g", "cy", "wanted"))
    sites = [s for s in zip(x, g, cy, strict=True) if s[1] is not None]
    asked = [a for a, w in zip(x, wanted, strict=True) if w] if sites else []
    found = nearest_along(sites, asked)
    columns = [pa.array([key[0].as_py()] * len(asked), type=rows.schema.field("map_id").type), pa.array([key[1].as_py()] * len(asked), type=pa.int32()), pa.array(asked, type=pa.int32())]
    return pa.Table.from_arrays([*columns, *(pa.array([f[k] for f in found], type=t) for k, t in ((1, pa.int32()), (2, pa.int32()), (0, pa.int64())))], names=["map_id", "y", "x", "ny", "nx", "d2"])


def nearest_set(plane: DataFrame, target: str, wanted: str | None = None) -> DataFrame:
    """``(map_id, y, x, ny, nx, d2)``: nearest pixel where ``target`` holds, ties by ``(d2, ny, nx)``.

    ``plane`` is dense. ``wanted`` names a column that marks the pixels to answer for
    (default all). Maps without a target give no rows.
    """
    up = Window.partitionBy("map_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("map_id", "x").orderBy("y").rowsBetween(0, Window.unboundedFollowing)
    side = F.when(F.col(target), F.col("y"))
    column = plane.withColumn("__a", F.last(side, ignorenulls=True).over(up)).withColumn("__b", F.first(side, ignorenulls=True).over(down))
    a, b = F.col("y") - F.col("__a"), F.col("__b") - F.col("y")
    cy = F.when(b.isNull() | (a <= b), F.col("__a")).otherwise(F.col("__b"))
    rows = column.select("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.abs(F.col("y") - cy).cast("int").alias("g"), cy.cast("int").alias("cy"), (F.col(wanted) if wanted else F.lit(True)).alias("wanted"))
    schema = StructType([plane.schema["map_id"], *(StructField(n, IntegerType()) for n in ("y", "x", "ny", "nx")), StructField("d2", LongType())])
    return rows.where("wanted or g is not null").groupBy("map_id", "y").applyInArrow(_nearest_in_row, schema)


def fill_from_nearest(plane: DataFrame, value: str, hole: str) -> DataFrame:
    """Pixels where ``hole`` holds take ``value`` of the nearest pixel where it does not."""
    found = nearest_set(plane.withColumn("__solid", ~F.col(hole)), "__solid", hole).select("map_id", "y", "x", "ny", "nx")
    source = plane.select("map_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(value).alias("__v"))
    told = found.join(source, ["map_id", "ny", "nx"]).select("map_id", "y", "x", "__v")
    return plane.join(told, ["map_id", "y", "x"], "left").withColumn(value, F.when(F.col(hole), F.coalesce("__v", value)).otherwise(F.col(value))).drop("__v")


def snap(points: DataFrame, cells: DataFrame, large: DataFrame, cell_px: int) -> DataFrame:
    """Nearest passable cell of a large enough component for points ``(map_id, pid, px, py)`` in pixels.

    ``cells`` is ``(map_id, r, c, cost)``; ``large`` the cells ``(map_id, r, c)`` that may
    be snapped to. Points are clamped into the grid; ties go by ``(d2, r, c)``. Points
    of maps without such a cell are absent. Cells around a point are searched in rings
    of doubling width, so a point near passable ground joins few cells.
    """
    size = cells.groupBy("map_id").agg(F.max("r").alias("h"), F.max("c").alias("w"))
    at = points.join(size, "map_id").select("map_id", "pid", "h", "w", F.greatest(F.lit(0), F.least("h", F.floor(F.col("py") / cell_px))).alias("r0"), F.greatest(F.lit(0), F.least("w", F.floor(F.col("px") / cell_px))).alias("c0"))
    found = None
    left, radius = at, 8
    far = at.agg(F.max(F.greatest("h", "w"))).first()[0] or 0
    while True:
        asked = left.select("map_id", "pid", "r0", "c0", F.explode(F.sequence(F.greatest(F.lit(0), F.col("r0") - radius), F.least("h", F.col("r0") + radius))).alias("r"))
        near = asked.join(large, ["map_id", "r"]).where(F.abs(F.col("c") - F.col("c0")) <= radius)
        d2 = (F.col("r") - F.col("r0")) * (F.col("r") - F.col("r0")) + (F.col("c") - F.col("c0")) * (F.col("c") - F.col("c0"))
        best = near.groupBy("map_id", "pid").agg(F.min(F.struct(d2.alias("d2"), "r", "c")).alias("s")).where((F.col("s.d2") <= radius * radius) | F.lit(radius >= far))
        found = best if found is None else found.union(best)
        if radius >= far:
            break
        left = left.join(best, ["map_id", "pid"], "left_anti")
        if left.isEmpty():
            break
        radius = min(radius * 4, far)
    return found.select("map_id", "pid", "s.r", "s.c", "s.d2")
