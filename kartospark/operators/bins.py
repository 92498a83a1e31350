"""Joins by distance on a grid: rows meet in cells as wide as the distance asked for, never by map alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(points: DataFrame, boxes: DataFrame, at: tuple[str, str], x: tuple[Column, Column], y: tuple[Column, Column], reach: Column) -> DataFrame:
    """Pairs of a map's ``points`` and ``boxes`` that may be closer than the box's ``reach``: all that are, and few others.

    ``at`` names the columns of a point, ``x`` and ``y`` are a box's ends. Columns of both
    sides must differ but for ``map_id``. A box lies on a grid whose cells are ``reach``
    rounded up to a power of two wide, in all cells that it reaches into; a point lies in
    one cell of each such grid. The widths that occur, a few dozen at most, are asked
    for first.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(reach, F.lit(1.0))))).cast("int")
    levels = [r[0] for r in boxes.select(level).distinct().collect() if r[0] is not None]
    size = F.pow(F.lit(2.0), F.col("__level"))

    def cells(ends: tuple[Column, Column]) -> Column:
        low, high = (F.floor(e / size).cast("long") for e in (ends[0] - reach, ends[1] + reach))
        return F.explode(F.sequence(low, F.greatest(low, high)))

    spread = boxes.withColumn("__level", level).where("__level is not null").withColumn("__gx", cells(x)).withColumn("__gy", cells(y))
    here = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    here = here.withColumns({"__gx": F.floor(F.col(at[0]) / size).cast("long"), "__gy": F.floor(F.col(at[1]) / size).cast("long")})
    return here.join(spread, ["map_id", "__level", "__gx", "__gy"]).drop("__level", "__gx", "__gy")
