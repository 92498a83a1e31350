"""Values of a whole map brought to each of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a map are dealt into.
PARTS = 64


def with_map_values(rows: DataFrame, values: DataFrame, across: str = "x", how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``values``, at most one small row a map.

    Where there are too many maps for their values to be broadcast, rows and values meet
    by map and part, ``across`` (a coordinate) being dealt into ``PARTS``: no task gets a
    whole map.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    dealt = rows.withColumn("__part", F.pmod(F.col(across), F.lit(PARTS)).cast("int"))
    return dealt.join(values.withColumn("__part", parts), ["map_id", "__part"], how).drop("__part")


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that follow the number of pixels, always by sorted shuffles.

    Pixels take few bytes on disk, and rows that are made of a row are not counted, so
    Spark would take such tables for small ones and broadcast them through the driver.
    """
    return left.join(right.hint("merge"), on, how)
