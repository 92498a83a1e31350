"""The start triangle: outlines of all sizes and turns matched against distances to ink, tile by tile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartospark.operators.graph import mask_components
from kartospark.operators.rings import interior_fill, sampled
from kartospark.settings import Settings
from kartospark.sources.shared import written

#: Pixels of a tile's side.
TILE = 128
# Sizes tried, from the least to the most allowed, and degrees between turns, up to a third of a circle.
N_SIZES, TURN = 5, 6.0
N_TURNS = round(120 / TURN)
# Most ink inside and outside a triangle, and where outside is looked at.
MOST_INSIDE, MOST_OUTSIDE, N_OUTSIDE = 0.1, 0.25, 9


def _side(n: Column | int, nominal: Column | float, tol: float):
    """Side of the n-th size."""
    return nominal * (1 - tol + 2 * tol * n / (N_SIZES - 1))


def _corners(side: float, turn: float) -> np.ndarray:
    angle = np.deg2rad(turn + np.array([-90.0, 30.0, 150.0]))
    return side / math.sqrt(3) * np.stack([np.cos(angle), np.sin(angle)], axis=1)


def outline(side: float, turn: float) -> np.ndarray:
    """Pixels ``(dx, dy)`` of a triangle's outline around its centre."""
    corner = np.rint(_corners(side, turn))
    edges = [a + (b - a) * np.linspace(0, 1, 1 + int(np.abs(b - a).max()))[:, None] for a, b in zip(corner, np.roll(corner, -1, axis=0), strict=True)]
    return np.unique(np.rint(np.concatenate(edges)).astype(int), axis=0)


def _distance(ink: np.ndarray, most: float) -> np.ndarray:
    """Distance of each pixel to the nearest ink, ``most`` where it is farther."""
    out, reach = np.full(ink.shape, most), math.ceil(most)
    padded = np.pad(ink, reach)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if (d := math.hypot(dy, dx)) < most:
                there = padded[reach + dy : reach + dy + ink.shape[0], reach + dx : reach + dx + ink.shape[1]]
                np.minimum(out, d, out=out, where=there)
    return out


def _matched(tile: pd.DataFrame, nominal: float, halo: int, tol: float) -> pd.DataFrame:
    """Places of one tile where some outline lies near ink all along and the middle is empty."""
    y0, x0 = int(tile["ty"].iloc[0]) * TILE - halo, int(tile["tx"].iloc[0]) * TILE - halo
    ink = np.zeros((TILE + 2 * halo, TILE + 2 * halo), dtype=bool)
    ink[tile["y"].to_numpy() - y0, tile["x"].to_numpy() - x0] = True
    hollow = 0.5 * _side(0, nominal, tol) / (2 * math.sqrt(3))
    cut = max(3.0, 0.15 * nominal)
    distance = _distance(ink, max(cut, hollow + 1e-9))
    near = np.minimum(distance, cut)
    empty = distance[halo : halo + TILE, halo : halo + TILE] > hollow
    height, width = int(tile["height"].iloc[0]), int(tile["width"].iloc[0])
    empty[max(0, height - y0 - halo) :] = False
    empty[:, max(0, width - x0 - halo) :] = False
    found = []
    for size in range(N_SIZES):
        for turn in range(N_TURNS):
            at = outline(_side(size, nominal, tol), turn * TURN)
            score = np.mean([near[halo + dy : halo + dy + TILE, halo + dx : halo + dx + TILE] for dx, dy in at.tolist()], axis=0)
            y, x = np.nonzero(empty & (score <= max(1.0, 0.04 * nominal)))
            found.append(pd.DataFrame({"size": size, "turn": turn, "y": y + y0 + halo, "x": x + x0 + halo, "score": score[y, x]}))
    return pd.concat(found).assign(map_id=tile["map_id"].iloc[0])[["map_id", "size", "turn", "y", "x", "score"]]


def starts(mask: DataFrame, size: DataFrame, r0: DataFrame, circles: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """``(map_id, cx, cy, r)``: each map's start, its best-matched triangle that is empty inside and has little ink along its sides.

    ``size`` is ``(map_id, height, width)``, ``r0`` ``(map_id, r0)``; triangles centred in
    one of ``circles`` (``map_id, cx, cy, cr``) are none. Of each connected area of good
    places for one size and turn the best stands for all.
    """
    cfg = cfg or Settings()
    tol = cfg.start_side_tol_ratio
    scaled = r0.select("map_id", (cfg.start_side_mm * 2 * F.col("r0") / cfg.control_diameter_mm).alias("nominal")).join(size, "map_id")
    halo = F.ceil(F.col("nominal") * (1 + tol) / math.sqrt(3) + F.greatest(F.lit(3.0), 0.15 * F.col("nominal"))).cast("int") + 3
    near = mask.select("map_id", "y", "x").join(scaled.withColumn("halo", halo), "map_id")

    def tiles(c: str) -> Column:
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - F.col("halo")) / TILE)), F.floor((F.col(c) + F.col("halo")) / TILE)))

    key = mask.schema["map_id"].dataType.simpleString()
    dealt = near.withColumn("ty", tiles("y")).withColumn("tx", tiles("x"))

    def match(tile: pd.DataFrame) -> pd.DataFrame:
        h = int(tile["halo"].iloc[0])
        lo_y, lo_x = tile["ty"] * TILE - h, tile["tx"] * TILE - h
        inside = (tile["y"] >= lo_y) & (tile["y"] < lo_y + TILE + 2 * h) & (tile["x"] >= lo_x) & (tile["x"] < lo_x + TILE + 2 * h)
        return _matched(tile[inside], float(tile["nominal"].iloc[0]), h, tol) if inside.any() else pd.DataFrame({n: [] for n in ("map_id", "size", "turn", "y", "x", "score")})

    low = written(dealt.groupBy("map_id", "ty", "tx").applyInPandas(match, f"map_id {key}, size int, turn int, y int, x int, score double"))
    keyed = low.withColumn("map_id", F.struct("map_id", "size", "turn"))
    areas = mask_components(keyed.select("map_id", "y", "x")).join(keyed, ["map_id", "y", "x"])
    first = F.row_number().over(Window.partitionBy("map_id", "comp").orderBy("score", "y", "x"))
    best = areas.withColumn("__n", first).where("__n = 1").select("map_id.*", "y", "x", "score").join(scaled, "map_id")
    side = _side(F.col("size"), F.col("nominal"), tol)
    best = best.select("map_id", "height", "width", F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), side.alias("side"), (F.col("turn") * TURN).alias("theta"), "score", (side / math.sqrt(3)).alias("r"))

    def corner(i: int) -> tuple[Column, Column]:
        a = F.radians(F.col("theta") + (-90.0, 30.0, 150.0)[i])
        return F.col("cx") + F.col("r") * F.cos(a), F.col("cy") + F.col("r") * F.sin(a)

    within = [x.between(0, F.col("width") - 1) & y.between(0, F.col("height") - 1) for x, y in map(corner, range(3))]
    o = circles.select(F.col("map_id").alias("om"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("cr").alias("o_r"))
    inside = (F.col("map_id") == F.col("om")) & (F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")) < F.col("o_r"))
    left = written(best.where(within[0] & within[1] & within[2]).join(o, inside, "left_anti").withColumn("cid", F.struct("score", "cx", "cy", "side", "theta")))

    inner = F.col("side") / (2 * math.sqrt(3))
    hollow = interior_fill(left.withColumn("cr", 0.5 * inner).drop("height", "width"), mask, size, 1.0).where(F.col("fill") <= MOST_INSIDE)
    points = None
    for i in range(3):
        (ax, ay), (bx, by) = corner(i), corner((i + 1) % 3)
        mx, my = (ax + bx) / 2 - F.col("cx"), (ay + by) / 2 - F.col("cy")
        out = F.greatest(F.lit(2.0), 0.35 * inner) / F.hypot(mx, my)
        t = 0.25 + 0.5 * F.col("k") / (N_OUTSIDE - 1)
        spread = left.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(N_OUTSIDE - 1))))
        some = spread.select("map_id", "cid", (ax + (bx - ax) * t + mx * out).alias("px"), (ay + (by - ay) * t + my * out).alias("py"))
        points = some if points is None else points.unionByName(some)
    clear = sampled(points, mask).groupBy("map_id", "cid").agg(F.avg(F.col("hit").cast("int")).alias("ink")).where(F.col("ink") <= MOST_OUTSIDE)
    good = left.join(hollow.select("map_id", "cid"), ["map_id", "cid"], "left_semi").join(clear.select("map_id", "cid"), ["map_id", "cid"], "left_semi")
    return good.groupBy("map_id").agg(F.min_by(F.struct("cx", "cy", "r"), F.col("cid")).alias("s")).select("map_id", "s.*")
