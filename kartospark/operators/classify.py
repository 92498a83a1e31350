"""Terrain classes of pixels: nearest reference colour, user samples, costs and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartospark.functions.color import with_lab
from kartospark.functions.maps import with_map_values
from kartospark.settings import CLASS_NAMES, DISPLAY_COLORS, REFERENCE_COLORS, UNKNOWN, Settings


def nearest_reference(df: DataFrame, refs: DataFrame, axes: list[str], max_distance: float | None, out: str = "label") -> DataFrame:
    """The class of the nearest reference for each row; the first reference wins ties, none within reach is ``UNKNOWN``.

    ``refs`` is ``(map_id, ref_idx, class_id, <axes>)``: a few dozen rows a map, folded to
    one array row a map, so pixels meet their references in an equi-join on the map, dealt
    into parts, and never multiply.
    """
    folded = refs.groupBy("map_id").agg(F.collect_list(F.struct("ref_idx", "class_id", *axes)).alias("__refs"))

    def scored(ref: Column) -> Column:
        d2 = sum(((F.col(a) - ref[a]) * (F.col(a) - ref[a]) for a in axes), F.lit(0))
        return F.struct(d2.alias("d2"), ref["ref_idx"].alias("ref_idx"), ref["class_id"].alias("class_id"))

    best = with_map_values(df, folded).withColumn("__best", F.array_min(F.transform("__refs", scored)))
    label = F.col("__best.class_id")
    if max_distance is not None:
        label = F.when(F.col("__best.d2") <= max_distance * max_distance, label).otherwise(F.lit(UNKNOWN))
    return best.withColumn(out, label.cast("int")).drop("__refs", "__best")


def checked_samples(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clicked points ``(map_id, class_name, sx, sy)`` with their class, in upper case as ``class_name`` and by number as ``class_id``, and those of no class.

    Rejects are ``(map_id, class_name, n, reason)``, one row a map and name as it was
    given; ``UNKNOWN`` and null are no class. A name without points has no rows, so it is
    in neither.
    """
    names = F.array(*map(F.lit, CLASS_NAMES[:UNKNOWN]))
    named = samples.withColumn("class_id", F.coalesce(F.array_position(names, F.upper("class_name")), F.lit(0)) - 1)
    good = named.where("class_id >= 0").withColumn("class_name", F.upper("class_name"))
    bad = named.where("class_id < 0").groupBy("map_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    return good, bad.withColumn("reason", F.lit("unknown class"))


def sample_references(pixels: DataFrame, samples: DataFrame, patch: int = 5) -> DataFrame:
    """``(map_id, class_id, sx, sy, r, g, b)``: mean colours, truncated, of patches around clicked points.

    ``samples`` is ``(map_id, class_name, sx, sy)``. Patches are clipped to the map; points
    outside it are dropped, as are those that ``checked_samples`` rejects.
    """
    half = patch // 2
    size = pixels.groupBy("map_id").agg(F.max("x").alias("__w"), F.max("y").alias("__h"))
    good = checked_samples(samples)[0].join(size, "map_id").where("sx between 0 and __w and sy between 0 and __h")
    spread = good.select("map_id", "class_id", "sx", "sy", F.explode(F.sequence(F.col("sy") - half, F.col("sy") + half)).alias("y")).withColumn("x", F.explode(F.sequence(F.col("sx") - half, F.col("sx") + half)))
    means = spread.join(pixels.select("map_id", "y", "x", "r", "g", "b"), ["map_id", "y", "x"]).groupBy("map_id", "class_id", "sx", "sy").agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    return means


def references(maps: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``(map_id, ref_idx, class_id, r, g, b)``: the default shades, those of sampled classes replaced by the samples."""
    shades = [(CLASS_NAMES.index(n), *rgb) for n, every in REFERENCE_COLORS.items() for rgb in every]
    default = maps.select("map_id", F.posexplode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("class_id", "r", "g", "b"), s, strict=True)]) for s in shades])).alias("pos", "s")).select("map_id", "pos", "s.*")
    if samples is not None:
        kept = default.join(samples.select("map_id", "class_id").distinct(), ["map_id", "class_id"], "left_anti")
        own = samples.select("map_id", F.lit(len(shades)).alias("pos"), "class_id", "r", "g", "b")
        default = kept.select("map_id", "pos", "class_id", "r", "g", "b").unionByName(own)
    return default.select("map_id", (F.col("class_id") * 10_000 + F.col("pos")).alias("ref_idx"), "class_id", "r", "g", "b")


def segment(pixels: DataFrame, refs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """``label`` of each pixel by the nearest reference in Lab; too far from all is ``UNKNOWN``."""
    cfg = cfg or Settings()
    return nearest_reference(with_lab(pixels), with_lab(refs).drop("r", "g", "b"), ["l", "a", "lab_b"], cfg.max_delta_e)


def by_class(label: Column, values: list) -> Column:
    """Look a class number up in a list of constants."""
    return F.element_at(F.array(*map(F.lit, values)), label + 1)


def fine_cost(label: Column, cfg: Settings | None = None) -> Column:
    return by_class(label, (cfg or Settings()).fine_costs())


def palette(label: Column) -> dict[str, Column]:
    """Display colour and alpha of a label."""
    return {c: by_class(label, [DISPLAY_COLORS[n][i] for n in CLASS_NAMES]) for i, c in enumerate("rgb")} | {"alpha": F.lit(255)}


def mask_rgba(mask: Column, rgba: tuple[int, int, int, int]) -> dict[str, Column]:
    return {c: F.when(mask, F.lit(v)).otherwise(F.lit(0)) for c, v in zip(("r", "g", "b", "alpha"), rgba, strict=True)}


def cost_ramp(cells: DataFrame) -> DataFrame:
    """Green to red by cost within each map, green where all costs are equal; forbidden cells are dark purple.

    Costs are compared to nine decimals: the last bits of a mean depend on the order in which its pixels came.
    """
    inf = F.lit(float("inf"))
    cost = F.round("cost", 9)
    ends = cells.where(F.col("cost") < inf).groupBy("map_id").agg(F.min(cost).alias("__lo"), F.max(cost).alias("__hi"))
    t = F.when(F.col("__hi") > F.col("__lo"), (cost - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    bad = ~(F.col("cost") < inf)

    def channel(forbidden: int, value: Column) -> Column:
        return F.when(bad, F.lit(forbidden)).otherwise(F.floor(value).cast("int"))

    ramp = with_map_values(cells, ends, "c", "left")
    return ramp.withColumns({"r": channel(40, 255 * t), "g": channel(0, 255 * (1 - t)), "b": F.lit(40), "alpha": F.lit(255)}).drop("__lo", "__hi")


def enlarged(cells: DataFrame, cell_px: int, size: DataFrame) -> DataFrame:
    """Each cell as ``cell_px`` squared pixels, trimmed to the map's ``(map_id, height, width)``."""
    grown = cells.withColumn("y", F.explode(F.sequence(F.col("r") * cell_px, F.col("r") * cell_px + cell_px - 1))).withColumn("x", F.explode(F.sequence(F.col("c") * cell_px, F.col("c") * cell_px + cell_px - 1)))
    return with_map_values(grown, size).where("y < height and x < width").drop("height", "width")


def placed(layer: DataFrame, x0: int, y0: int) -> DataFrame:
    """A layer of a crop in the coordinates of the whole image; pixels without a row are transparent."""
    return layer.withColumns({"x": F.col("x") + x0, "y": F.col("y") + y0})


def crop(pixels: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Pixels inside ``(x0, y0, x1, y1)``, ends exclusive, with the origin moved there."""
    x0, y0, x1, y1 = box
    x0, y0 = max(x0, 0), max(y0, 0)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("empty crop")
    return pixels.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
