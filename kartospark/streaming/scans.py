"""Maps that arrive as files: each micro-batch is segmented and its cells appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kartospark.operators.terrain import cell_size, cost_cells
from kartospark.plans.analysis import segmentation, terrain_planes
from kartospark.settings import Settings

PIXELS = "map_id string, y int, x int, r int, g int, b int"


def pixel_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Pixel tables as they are written below ``path``, whole maps a file."""
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def cost_cells_of(pixels: DataFrame, px_per_mm: float, cfg: Settings | None = None) -> DataFrame:
    planes = terrain_planes(segmentation(pixels, cfg), px_per_mm, cfg)
    return cost_cells(planes, cell_size(px_per_mm, cfg), cfg)


def run(pixels: DataFrame, out: str, checkpoint: str, px_per_mm: float, cfg: Settings | None = None) -> StreamingQuery:
    """Start a query that stores each batch's cost cells under its number; a batch that is redone replaces its own."""

    def store(batch: DataFrame, number: int) -> None:
        cost_cells_of(batch, px_per_mm, cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pixels.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
