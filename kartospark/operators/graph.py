"""Connected components of graphs and of raster masks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from kartospark.functions.maps import meet
from kartospark.sources.shared import checkpointed, written


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph ``(a, b)``, as ``(v, root)`` with the smallest vertex as root.

    Alternating large-star and small-star steps (Kiveris et al. 2014): neighbours of a
    node are linked to its smallest neighbour until only stars are left. Each step is a
    map-side combined ``min`` and an equi-join, so a hub is never gathered in one task;
    rounds grow with the logarithm of a component's size. Vertices are any orderable
    type; self-loops and repeats are allowed.
    """

    def orient(df: DataFrame) -> DataFrame:
        return df.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct()

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    cur = checkpointed(orient(edges.selectExpr("a u", "b v")))
    was = mark(cur)
    while was[0]:
        # A node's larger neighbours move to its smallest neighbour, which only its edges to smaller ones can name.
        lower = cur.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        large = cur.join(lower, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v u", "m v").union(least.selectExpr("u", "m v"))
        cur = checkpointed(orient(small))
        now = mark(cur)
        if now == was:
            break
        was = now
    return cur.selectExpr("u v", "v root").union(cur.selectExpr("v", "v root").distinct())


#: Rows of pixels that are labelled together in a task, and bands whose parts then are.
BAND, BANDS = 64, 64


def _connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest of ``n`` numbers that each is connected to by the pairs: roots move to smaller ones, then paths are halved."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups of sorted rows. ``nth`` is 1 for a group's first; the last group of a batch may go on in the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.flatnonzero(batch.column("nth").to_numpy() == 1)
        if len(cut):
            done = [*held, batch.slice(0, int(cut[-1]))]
            if sum(b.num_rows for b in done):
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            held, batch = [], batch.slice(int(cut[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _band_batches(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Runs of each band, those that abut as one, and the first run ``(ry, rx)`` of what each is part of within the band.

    Rows come sorted by band, ``y`` and ``x0``.
    """

    def labelled(rows: pa.RecordBatch) -> pa.RecordBatch:
        nth, y, x0, x1 = (rows.column(c).to_numpy().astype(np.int64) for c in ("nth", "y", "x0", "x1"))
        band = nth == 1
        step = np.diff(y, prepend=y[:1])
        new = band | (step != 0)
        first = new.copy()
        first[1:] |= x0[1:] != x1[:-1] + 1
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(y)) - 1
        # Rows are numbered so that only those that are neighbours in one band have neighbouring numbers.
        row = np.cumsum(np.where(new, np.where(band | (step != 1), 2, 1), 0))[at]
        left = x0.min() - 2
        a, b = x0[at] - left, x1[last] - left
        span = b.max() + 4
        low = np.searchsorted(row * span + b, (row - 1) * span + a - reach, "left")
        high = np.searchsorted(row * span + a, (row - 1) * span + b + reach, "right")
        n = np.maximum(high - low, 0)
        i = np.repeat(np.arange(len(at)), n)
        root = _connected(len(at), i, np.repeat(low, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
        take = pa.array(at)
        kind_y, kind_x = rows.schema.field("y").type, rows.schema.field("x0").type
        columns = [rows.column("map_id").take(take), rows.column("y").take(take), rows.column("x0").take(take), rows.column("x1").take(pa.array(last)), pa.array(y[at][root]).cast(kind_y), pa.array(x0[at][root]).cast(kind_x)]
        return pa.RecordBatch.from_arrays(columns, names=["map_id", "y", "x0", "x1", "ry", "rx"])

    return map(labelled, _whole_groups(batches))


def _star_batches(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Parts ``(ay, ax)`` that touch ``(by, bx)`` in the band above, as links from each to the first that it is connected to within a group of bands, ``height`` rows. Links to another group, at the first row of one, stay and are ``far``.

    Rows come sorted by group of bands.
    """

    def linked(rows: pa.RecordBatch) -> pa.RecordBatch:
        nth, y, *ends = (rows.column(c).to_numpy().astype(np.int64) for c in ("nth", "y", "ay", "ax", "by", "bx"))
        far = y % height == 0
        near, far = np.flatnonzero(~far), np.flatnonzero(far)
        group = np.cumsum(nth == 1)[near] - 1
        parts, which = np.unique(np.concatenate([np.stack([group, ends[k][near], ends[k + 1][near]], axis=1) for k in (0, 2)]), axis=0, return_inverse=True)
        root = _connected(len(parts), *which.reshape(2, -1))
        moved = np.flatnonzero(root != np.arange(len(parts)))
        take = pa.array(np.concatenate([np.flatnonzero(nth == 1)[parts[moved, 0]], far]))
        links = [parts[moved, 1], parts[moved, 2], parts[root[moved], 1], parts[root[moved], 2]]
        columns = [pa.array(np.concatenate([new, old[far]])).cast(rows.schema.field(n).type) for n, new, old in zip(("ay", "ax", "by", "bx"), links, ends, strict=True)]
        return pa.RecordBatch.from_arrays([rows.column("map_id").take(take), *columns, pa.array(np.arange(len(take)) >= len(moved))], names=["map_id", "ay", "ax", "by", "bx", "far"])

    return map(linked, _whole_groups(batches))


def run_components(pieces: DataFrame, diagonal: bool = True) -> DataFrame:
    """``(map_id, y, x0, x1, comp)``: runs of a mask given as pieces of rows ``(map_id, y, x0, x1)``, and the first pixel ``(y, x)`` of each one's component.

    Bands of ``BAND`` rows are labelled in tasks, then parts of ``BANDS`` bands that touch;
    only links between groups of so many bands are a graph, whose components name them.
    So what is shuffled follows what crosses bands, and rounds what crosses such groups.
    """
    reach = 1 if diagonal else 0
    kind = pieces.schema
    banded = pieces.select("map_id", "y", "x0", "x1", F.floor(F.col("y") / BAND).alias("band"))
    banded = banded.withColumn("nth", F.row_number().over(Window.partitionBy("map_id", "band").orderBy("y", "x0")))
    told = StructType([kind["map_id"], *[StructField(n, kind[c].dataType) for n, c in (("y", "y"), ("x0", "x0"), ("x1", "x1"), ("ry", "y"), ("rx", "x0"))]])
    r = written(banded.select("map_id", "y", "x0", "x1", "nth").mapInArrow(partial(_band_batches, reach=reach), told)).withColumn("id", F.struct("map_id", F.col("ry").alias("y"), F.col("rx").alias("x")))
    above = r.where(F.pmod("y", F.lit(BAND)) == BAND - 1).select(F.col("map_id").alias("m"), (F.col("y") + 1).alias("yy"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("ry").alias("by"), F.col("rx").alias("bx"))
    touch = (F.col("map_id") == F.col("m")) & (F.col("y") == F.col("yy")) & (F.col("x0") <= F.col("a1") + reach) & (F.col("a0") <= F.col("x1") + reach)
    pairs = r.where(F.pmod("y", F.lit(BAND)) == 0).join(above, touch).select("map_id", "y", F.col("ry").alias("ay"), F.col("rx").alias("ax"), "by", "bx")
    pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("map_id", F.floor(F.col("y") / (BAND * BANDS))).orderBy("y")))
    ends = [StructField(n, kind[c].dataType) for n, c in (("ay", "y"), ("ax", "x0"), ("by", "y"), ("bx", "x0"))]
    links = written(pairs.mapInArrow(partial(_star_batches, height=BAND * BANDS), StructType([kind["map_id"], *ends, StructField("far", BooleanType())])))
    a, b = (F.struct("map_id", F.col(f"{end}y").alias("y"), F.col(f"{end}x").alias("x")) for end in "ab")
    near, far = (links.where(c).select(a.alias("a"), b.alias("b")) for c in ("not far", "far"))
    if far.isEmpty():
        roots = near.selectExpr("a id", "b root").union(connected_components(far).toDF("id", "root"))
    else:
        first = [near.toDF(end, f"{end}_root") for end in "ab"]
        met = meet(meet(far, first[0], ["a"], "left"), first[1], ["b"], "left")
        met = connected_components(met.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))).toDF("b", "root")
        roots = meet(near, met, ["b"], "left").select(F.col("a").alias("id"), F.coalesce("root", "b").alias("root")).union(met)
    named = meet(r, roots, ["id"], "left").withColumn("root", F.coalesce("root", "id"))
    return named.select("map_id", "y", "x0", "x1", F.struct(F.col("root.y").alias("y"), F.col("root.x").alias("x")).alias("comp"))


def run_pixels(labelled: DataFrame) -> DataFrame:
    """Pixels ``(map_id, y, x)`` of runs, with the other columns."""
    rest = [c for c in labelled.columns if c not in ("map_id", "y", "x0", "x1")]
    return labelled.select("map_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *rest)


def mask_components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """``(map_id, y, x, comp)`` for every pixel of a sparse mask; ``comp`` is the component's first pixel ``(y, x)``."""
    return run_pixels(run_components(mask.select("map_id", "y", F.col("x").alias("x0"), F.col("x").alias("x1")), diagonal))


def component_stats(labelled: DataFrame) -> DataFrame:
    """Area and bounding box of each component."""
    return labelled.groupBy("map_id", "comp").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


def line_like(stats: DataFrame, px_per_mm: float, min_bbox_mm: float = 2.0, min_elongation: float = 3.0) -> DataFrame:
    """Components that are lines rather than specks or text: large, or of fair size and elongated."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    big, small = F.greatest(w, h), F.least(w, h)
    return stats.where((big >= min_bbox_mm * px_per_mm) | ((big >= min_elongation * small) & (big >= min_bbox_mm / 2 * px_per_mm)))


def fill_holes(plane: DataFrame) -> DataFrame:
    """Set pixels of ``(map_id, y, x, on)``, a dense plane, that are off and cannot reach its border (4-connected)."""
    off = mask_components(plane.where(~F.col("on")).select("map_id", "y", "x"), diagonal=False)
    edge = plane.groupBy(F.col("map_id").alias("em")).agg(F.max("y").alias("ey"), F.max("x").alias("ex"))
    outer = off.join(edge, F.col("map_id") == F.col("em"))
    outer = outer.where((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("ey")) | (F.col("x") == F.col("ex"))).select("map_id", "comp").distinct()
    holes = meet(off, outer, ["map_id", "comp"], "left_anti").select("map_id", "y", "x", F.lit(True).alias("hole"))
    return meet(plane, holes, ["map_id", "y", "x"], "left").select("map_id", "y", "x", (F.col("on") | F.col("hole").isNotNull()).alias("on"))
