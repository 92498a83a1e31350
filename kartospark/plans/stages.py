"""Stages whose results are kept for each map, by a key of all that they depend on.

A key is the hash of a map's content, or of the key of the stage before, with the
settings that the stage reads. A stage is made only for maps whose key has no result yet,
all of them in one job; the others are read. So what is downstream of a change is made
again, and nothing else.

Results of one job lie in a folder of their own. A line of the index tells which keys
they are of, and is written after them: a job that fails leaves nothing that is ever
read, and of two jobs that make one key at once, one is taken.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartospark.operators.terrain import cell_size
from kartospark.plans import analysis
from kartospark.settings import Settings
from kartospark.sources.shared import written

# Settings that each stage reads, but for those that stages before it have read.
SEGMENT = ("bilateral_sigma_color", "bilateral_sigma_space", "white_percentile", "max_delta_e", "unknown_fill_iterations", "sample_patch_px")
TERRAIN = (
    "purple_dilate_px", "hatch_enabled", "hatch_min_holes", "hatch_hole_min_mm", "hatch_hole_max_mm", "hatch_min_size_mm", "hatch_window_mm", "hatch_density_min_ratio", "hatch_open_mm",
    "thick_line_mm", "line_blur_px", "line_min_length_px", "line_window_px", "building_outline_px", "building_min_width_mm", "line_min_bbox_mm", "line_min_elongation_ratio",
    "outside_map_enabled", "map_gap_mm", "water_min_width_mm",
)
GRID = ("cell_mm", "cost_beige", "cost_white", "cost_yellow", "cost_brown", "cost_black_thin", "cost_green", "cost_unknown", "cost_purple")
_INDEX = "key string, run string"


class Store(NamedTuple):
    """Results below ``path``, a folder that all executors share."""

    spark: SparkSession
    path: str

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _known(self, stage: str) -> DataFrame:
        at = f"{self.path}/{stage}/index"
        if not self._exists(at):
            return self.spark.createDataFrame([], _INDEX)
        return self.spark.read.schema(_INDEX).parquet(at).groupBy("key").agg(F.min("run").alias("run"))

    def result(self, stage: str, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage's rows for the maps of ``keys`` (``map_id, key``); ``make`` gets the ``map_id`` of those without a result.

        Rows of maps with equal keys, such as copies of one scan, are made once for each map.
        """
        keyed = written(keys.select("map_id", F.sha2(F.concat_ws("|", "key", F.col("map_id").cast("string")), 256).alias("key")))
        todo = written(keyed.join(self._known(stage).select("key"), "key", "left_anti"))
        if not todo.isEmpty():
            run = uuid.uuid4().hex
            named = todo.withColumnRenamed("map_id", "__map")
            made = make(todo.select("map_id")).join(named, F.col("map_id") == F.col("__map")).drop("__map")
            made.write.parquet(f"{self.path}/{stage}/run={run}")
            todo.select("key", F.lit(run).alias("run")).coalesce(1).write.mode("append").parquet(f"{self.path}/{stage}/index")
        wanted = written(keyed.select("key").join(self._known(stage), "key"))
        runs = sorted(r[0] for r in wanted.select("run").distinct().collect())
        if not runs:
            return make(keyed.select("map_id"))
        rows = [self.spark.read.parquet(f"{self.path}/{stage}/run={run}").join(wanted.where(F.col("run") == run).select("key"), "key", "left_semi").drop("key") for run in runs]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out


def content_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """``(map_id, key)``: a hash of each map's rows in any order; summed in the tasks first, so no map is gathered."""
    rows = rows.select("map_id", F.xxhash64(*columns, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))
    return rows.groupBy("map_id").agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(20,0)")), F.bit_xor("b"), F.bit_xor(F.xxhash64("a", "b"))), 256).alias("key"))


def next_keys(keys: DataFrame, stage: str, settings: dict, *more: DataFrame | None) -> DataFrame:
    """Keys of the stage after ``keys``: with its settings and with keys of other inputs, which some maps, or all, may lack."""
    told = keys
    for i, extra in enumerate(more):
        told = told.withColumn(f"k{i}", F.lit(None).cast("string")) if extra is None else told.join(extra.select("map_id", F.col("key").alias(f"k{i}")), "map_id", "left")
    parts: list[Column] = [F.col("key"), F.lit(stage), F.lit(json.dumps(settings, sort_keys=True, default=repr))]
    return told.select("map_id", F.sha2(F.concat_ws("|", *parts, *[F.coalesce(f"k{i}", F.lit("-")) for i in range(len(more))]), 256).alias("key"))


def read_by(cfg: Settings, names: tuple[str, ...]) -> dict:
    return {n: getattr(cfg, n) for n in names}


def analysed(store: Store, pixels: DataFrame, px_per_mm: float, samples: DataFrame | None = None, edits: DataFrame | None = None, cfg: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Planes and cost cells of maps ``(map_id, y, x, r, g, b)``, of which stored stages are read and others made and stored.

    ``samples`` and ``edits`` are as in ``segmentation`` and ``cost_grid``; a map's own
    ones are part of its keys, so those of another map change nothing for it.
    """
    cfg = cfg or Settings()
    own_samples = content_keys(samples, "class_name", "sx", "sy") if samples is not None else None
    own_edits = content_keys(edits, "edit_id", "kind", "points") if edits is not None else None

    def of(rows: DataFrame | None, maps: DataFrame) -> DataFrame | None:
        return None if rows is None else rows.join(maps, "map_id", "left_semi")

    seg_keys = next_keys(content_keys(pixels, "y", "x", "r", "g", "b"), "segment", read_by(cfg, SEGMENT), own_samples)
    labels = store.result("segment", seg_keys, lambda maps: analysis.segmented(of(pixels, maps), cfg, of(samples, maps)))
    terrain_keys = next_keys(seg_keys, "terrain", read_by(cfg, TERRAIN) | {"px_per_mm": px_per_mm})
    planes = store.result("terrain", terrain_keys, lambda maps: analysis.terrain_planes(of(labels, maps), px_per_mm, cfg, of(labels, maps)))
    grid_keys = next_keys(terrain_keys, "grid", read_by(cfg, GRID) | {"cell": cell_size(px_per_mm, cfg)}, own_edits)
    cells = store.result("grid", grid_keys, lambda maps: analysis.cost_grid(of(planes, maps), px_per_mm, of(edits, maps), cfg))
    return planes, cells
