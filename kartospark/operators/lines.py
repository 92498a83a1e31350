"""Black strokes: skeletons, segments, widths and barriers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from kartospark.operators.graph import component_stats, line_like, mask_components
from kartospark.operators.nearest import nearest_set
from kartospark.operators.stencil import by_column, by_row, dilate, extent, mirrored, neighbours8, window_mean
from kartospark.settings import BLACK, Settings
from kartospark.sources.shared import written


def _half_pass(df: DataFrame, out: str, half: int) -> DataFrame:
    """One half of a thinning step on rows that hold every set pixel's eight neighbours; rows with nothing set around go."""

    def at(c: str, over: WindowSpec, step: int):
        col = F.lead(c).over(over) if step > 0 else F.lag(c).over(over)
        return F.coalesce(col, F.lit(0))

    rows = df.withColumn("__o", F.col(out).cast("int"))
    rows = rows.withColumns({"__w": at("__o", by_row(), -1), "__e": at("__o", by_row(), 1)})
    n8 = rows.withColumns({f"__{v}{h}": at(f"__{h}", by_column(), s) for v, s in (("n", -1), ("s", 1)) for h in "owe"})
    ring = [F.col(c) for c in ("__no", "__ne", "__e", "__se", "__so", "__sw", "__w", "__nw")]
    count = sum(ring[1:], ring[0])
    turns = sum(((ring[i] == 0) & (ring[(i + 1) % 8] == 1)).cast("int") for i in range(8))
    n, e, s, w = ring[0], ring[2], ring[4], ring[6]
    ends = ((n * e * s == 0) & (e * s * w == 0)) if half == 0 else ((n * e * w == 0) & (n * s * w == 0))
    drop = F.col(out) & count.between(2, 6) & (turns == 1) & ends
    return n8.where(F.col(out) | (count > 0)).select("map_id", "y", "x", (F.col(out) & ~drop).alias(out), (F.col("__fell") | drop).alias("__fell"))


def skeleton(plane: DataFrame, mask: str, out: str = "skel") -> DataFrame:
    """Zhang-Suen thinning of a dense plane's mask.

    Each of the two half passes reads the eight neighbours by windows along rows and
    columns and clears border pixels; passes repeat until none changes, about half the
    widest stroke's width. Only set pixels and those beside them are kept between passes:
    what a set pixel reads is then still there and next to it, and what others read does
    not matter.
    """
    band = dilate(plane.select("map_id", "y", "x", F.col(mask).alias(out)), out, 1, "__near").where("__near")
    df = written(band.select("map_id", "y", "x", out))
    while True:
        df = written(_half_pass(_half_pass(df.withColumn("__fell", F.lit(False)), out, 0), out, 1))
        if df.where("__fell").isEmpty():
            break
        df = df.drop("__fell")
    left = df.where(out).select("map_id", "y", "x", F.lit(True).alias(out))
    return written(plane.join(left, ["map_id", "y", "x"], "left").withColumn(out, F.coalesce(out, F.lit(False))))


def stroke_segments(plane: DataFrame, skel: str = "skel") -> DataFrame:
    """``(map_id, y, x, seg)``: skeleton pixels but for junctions (three or more of eight neighbours), by 8-connected segment."""
    free = neighbours8(plane, skel).where(F.col(skel) & (F.col("n8") < 3)).select("map_id", "y", "x")
    return mask_components(free).withColumnRenamed("comp", "seg")


def owners(plane: DataFrame, mask: str, skel: str, segments: DataFrame) -> DataFrame:
    """``(map_id, y, x, ny, nx, seg)`` for set pixels: the nearest skeleton pixel, and the segment that the pixel belongs to.

    That is the skeleton pixel's segment or, where it is a junction, which is in none, the
    segment nearest to the pixel itself.
    """
    near = written(nearest_set(plane, skel, mask).join(segments.select("map_id", F.col("y").alias("ny"), F.col("x").alias("nx"), "seg"), ["map_id", "ny", "nx"], "left").select("map_id", "y", "x", "ny", "nx", "seg"))
    left = near.where("seg is null").select("map_id", "y", "x", F.lit(True).alias("__left"))
    on = segments.select("map_id", "y", "x", F.lit(True).alias("__on"))
    marked = plane.select("map_id", "y", "x").join(on, ["map_id", "y", "x"], "left").join(left, ["map_id", "y", "x"], "left").withColumns({c: F.col(c).isNotNull() for c in ("__on", "__left")})
    passed = nearest_set(marked, "__on", "__left").select("map_id", "y", "x", F.col("ny").alias("sy"), F.col("nx").alias("sx"))
    passed = passed.join(segments.select("map_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("seg").alias("__s")), ["map_id", "sy", "sx"]).select("map_id", "y", "x", "__s")
    return near.join(passed, ["map_id", "y", "x"], "left").withColumn("seg", F.coalesce("seg", "__s")).drop("__s")


def segment_widths(owner: DataFrame, segments: DataFrame) -> DataFrame:
    """``(map_id, seg, area, length, width)``: pixels that a segment owns, by its length."""
    area = owner.where("seg is not null").groupBy("map_id", "seg").agg(F.count(F.lit(1)).alias("area"))
    length = segments.groupBy("map_id", "seg").agg(F.count(F.lit(1)).alias("length"))
    return area.join(length, ["map_id", "seg"]).withColumn("width", F.col("area") / F.greatest(F.col("length"), F.lit(1))).select("map_id", "seg", "area", "length", "width")


def axes(skel: DataFrame, size: DataFrame, half: int = 3) -> DataFrame:
    """``(map_id, y, x, tangent)``: principal axis of the skeleton pixels within the square around each, as an angle from the row.

    Second moments are sums of whole numbers, relative to the pixel, so they are exact.
    Each pixel adds to the windows that it is in; beyond the border it is mirrored.
    """
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-half, half + 1) for dx in range(-half, half + 1)])
    spread = mirrored(skel.select("map_id", "y", "x"), size, half).select("map_id", "py", "px", F.col("y").alias("vy"), F.col("x").alias("vx"), F.explode(steps).alias("o"))
    at = spread.select("map_id", (F.col("vy") + F.col("o.dy")).alias("y"), (F.col("vx") + F.col("o.dx")).alias("x"), "py", "px").join(skel.select("map_id", "y", "x"), ["map_id", "y", "x"], "left_semi")
    x, y = (F.col("px") - F.col("x")).cast("long"), (F.col("py") - F.col("y")).cast("long")
    m = at.groupBy("map_id", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    cross = 2 * (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy"))
    apart = (F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")) - (F.col("n") * F.col("yy") - F.col("sy") * F.col("sy"))
    return m.select("map_id", "y", "x", (0.5 * F.atan2(cross.cast("double"), apart.cast("double"))).alias("tangent"))


# Reach and step of a profile in pixels; samples at its middle that tell the line, and at each end that tell the ground; least depth in L*.
REACH, STEP = 4.0, 0.25
MIDDLE, GROUND, LEAST_DEPTH = 5, 4, 10.0
_SAMPLES = int(2 * REACH / STEP) + 1


def profile_widths(skel: DataFrame, light: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """``(map_id, y, x, width)``: stroke width in pixels at each skeleton pixel, full width at half depth of the lightness across it.

    ``light`` is a dense plane ``(map_id, y, x, l)``. Samples lie on the normal of the
    local axis, between pixels by bilinear weights, beyond the border as on it. The pixels
    that a profile needs, a few dozen, are joined to it; all else is done on arrays of a
    row. Width is 0 where the middle is not darker than halfway to the ground beside it.
    """
    size = extent(light) if size is None else size
    centre = _SAMPLES // 2
    along = axes(skel, size).join(F.broadcast(size), "map_id")

    def within(c: Column, end: str) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.col(end).cast("double"))

    def spot(k: Column) -> Column:
        off = k * STEP - REACH
        return F.struct(within(F.col("y") + F.cos("tangent") * off, "ey").alias("y"), within(F.col("x") - F.sin("tangent") * off, "ex").alias("x"))

    def key(y: Column, x: Column) -> Column:
        return (y - F.col("y")) * 16 + (x - F.col("x"))

    spots = F.transform(F.sequence(F.lit(0), F.lit(_SAMPLES - 1)), spot)

    def corners(s: Column) -> list[tuple[Column, Column]]:
        ys, xs = ((F.floor(s[c]).cast("int"), F.least(F.floor(s[c]).cast("int") + 1, F.col(end))) for c, end in (("y", "ey"), ("x", "ex")))
        return [(y, x) for y in ys for x in xs]

    needed = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.array(*[F.struct(y.alias("ly"), x.alias("lx")) for y, x in corners(s)]))))
    told = along.withColumn("spots", spots)
    asked = told.select("map_id", "y", "x", F.inline(needed))
    lit = light.select("map_id", F.col("y").alias("ly"), F.col("x").alias("lx"), F.col("l").cast("double").alias("l"))
    known = asked.join(lit, ["map_id", "ly", "lx"]).groupBy("map_id", "y", "x").agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("ly"), F.col("lx")), "l"))).alias("near"))

    def sample(s: Column) -> Column:
        fy, fx = s["y"] - F.floor(s["y"]), s["x"] - F.floor(s["x"])
        at = [F.element_at("near", key(y, x)) for y, x in corners(s)]
        return F.round(at[0] * (1 - fy) * (1 - fx) + at[1] * (1 - fy) * fx + at[2] * fy * (1 - fx) + at[3] * fy * fx, 6)

    line = F.array_min(F.slice("p", centre + 1 - MIDDLE // 2, MIDDLE))
    ground = F.greatest(F.array_max(F.slice("p", 1, GROUND)), F.array_max(F.slice("p", _SAMPLES + 1 - GROUND, GROUND)))
    dark = F.transform("p", lambda v: v <= F.round((line + ground) / 2, 6))

    def run(side: Column) -> Column:
        """Dark samples from the middle on."""
        first = F.array_position(side, F.lit(False))
        return F.when(first == 0, F.size(side)).otherwise(first - 1)

    width = (run(F.reverse(F.slice("dark", 1, centre + 1))) + run(F.slice("dark", centre + 1, centre + 1)) - 1) * STEP
    depth = ground - line
    profile = told.join(known, ["map_id", "y", "x"]).withColumn("p", F.transform("spots", sample)).withColumn("dark", dark)
    return profile.select("map_id", "y", "x", F.when(F.get("dark", F.lit(centre)) & (depth > LEAST_DEPTH), width).otherwise(0.0).alias("width"))


def locally_thick(thin: DataFrame, widths: DataFrame, px_per_mm: float, cfg: Settings) -> DataFrame:
    """Skeleton pixels ``(map_id, y, x)`` where widths measured around them are of a thick line in the mean, scan blur included.

    ``thin`` is the dense plane with its ``skel``; a few measured pixels must be near.
    """
    measured = thin.select("map_id", "y", "x", "skel").join(widths, ["map_id", "y", "x"], "left").withColumns({"width": F.coalesce("width", F.lit(0.0)), "__ok": F.coalesce(F.col("width") > 0, F.lit(False))})
    local = window_mean(measured, "width", "__ok", cfg.line_window_px, "mean", "n", extent(thin))
    least = math.hypot(cfg.thick_line_mm * px_per_mm, cfg.line_blur_px)
    return local.where(F.col("skel") & (F.col("mean") >= least) & (F.col("n") >= cfg.line_min_length_px)).select("map_id", "y", "x")


def barriers(plane: DataFrame, px_per_mm: float, cfg: Settings | None = None, light: DataFrame | None = None) -> DataFrame:
    """Adds ``barrier`` to ``plane`` (``label``, ``building``): black strokes too wide to cross, but for text and specks.

    A stroke's width is the area over the length of its segments or, with the lightness
    plane ``light`` (``map_id, y, x, l``), the mean of profiles around, if that is thick.
    """
    cfg = cfg or Settings()
    near = dilate(plane, "building", cfg.building_outline_px, "__near")
    black = written(near.withColumn("__black", (F.col("label") == BLACK) & ~F.col("__near")).drop("__near"))
    thin = skeleton(black, "__black")
    segments = written(stroke_segments(thin))
    owner = written(owners(thin, "__black", "skel", segments))
    thick = segment_widths(owner, segments).where((F.col("width") >= cfg.thick_line_mm * px_per_mm) & (F.col("length") >= 2)).select("map_id", "seg")
    wide = owner.join(thick, ["map_id", "seg"], "left_semi").select("map_id", "y", "x")
    if light is not None:
        measured = written(profile_widths(thin.where("skel").select("map_id", "y", "x"), light))
        spots = locally_thick(thin, measured, px_per_mm, cfg).withColumnsRenamed({"y": "ny", "x": "nx"})
        wide = wide.union(owner.join(spots, ["map_id", "ny", "nx"], "left_semi").select("map_id", "y", "x")).distinct()
    comps = written(mask_components(wide))
    kept = line_like(component_stats(comps), px_per_mm, cfg.line_min_bbox_mm, cfg.line_min_elongation_ratio).select("map_id", "comp")
    there = comps.join(kept, ["map_id", "comp"], "left_semi").select("map_id", "y", "x", F.lit(True).alias("__bar"))
    return plane.join(there, ["map_id", "y", "x"], "left").withColumn("barrier", F.col("__bar").isNotNull()).drop("__bar")
