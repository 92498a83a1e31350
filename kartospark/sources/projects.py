"""Project documents as an append-only table of versions, and stage results stored by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: what a project id looks like.
ID = r"^[a-f0-9]{8,32}$"


class ProjectNotFound(KeyError):
    """No project has that id."""


def save(projects: DataFrame, path: str) -> None:
    """Append versions; the last one written wins, as readers take the latest of an id."""
    projects.write.mode("append").parquet(path)


def latest(versions: DataFrame, key: str = "project_id", by: str = "version") -> DataFrame:
    """The newest version of each document."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by)))
    return versions.withColumn("__n", newest).where("__n = 1").drop("__n")


def load(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    found = latest(spark.read.parquet(path).where((F.col("project_id") == project_id) & F.col("project_id").rlike(ID)))
    if found.isEmpty():
        raise ProjectNotFound(project_id)
    return found


def listed(versions: DataFrame) -> DataFrame:
    """Newest versions, last modified first."""
    return latest(versions).orderBy(F.desc("modified"), "project_id")


def documents(bodies: DataFrame, schema: str = "project_id string, version long, name string, modified timestamp") -> tuple[DataFrame, DataFrame]:
    """Project documents of ``(path, body)``, JSON texts, and those that are none: ``(path, reason)``.

    A document that does not parse, or lacks an id of the right form or a version, is told
    apart and skipped; it does not fail the others.
    """
    found = bodies.select("path", F.from_json("body", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("d"))
    reason = (
        F.when(F.col("d").isNull() | F.col("d.__bad").isNotNull(), "malformed document")
        .when(~F.coalesce(F.col("d.project_id").rlike(ID), F.lit(False)), "no project id")
        .when(F.col("d.version").isNull(), "no version")
    )
    told = found.withColumn("reason", reason)
    return told.where("reason is null").select("d.*").drop("__bad"), told.where("reason is not null").select("path", "reason")


def stage_key(*parts: Column) -> Column:
    """sha256 of the JSON of everything that a stage's result depends on."""
    return F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256)


def stored(spark: SparkSession, path: str, key: str, make) -> DataFrame:
    """The stored result of a key, made and stored first where there is none."""
    at = f"{path}/key={key}"
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def clamped_crop(crop: DataFrame, least: int = 10) -> DataFrame:
    """Crops ``(x0, y0, x1, y1)`` in images of ``(width, height)``: sides sorted and clamped; those smaller than ``least`` fail."""
    xs, ys = F.array_sort(F.array("x0", "x1")), F.array_sort(F.array("y0", "y1"))

    def within(v: Column, most: str) -> Column:
        return F.greatest(F.lit(0), F.least(v, F.col(most)))

    cut = crop.withColumns({"x0": within(xs[0], "width"), "x1": within(xs[1], "width"), "y0": within(ys[0], "height"), "y1": within(ys[1], "height")})
    bad = (F.col("x1") - F.col("x0") < least) | (F.col("y1") - F.col("y0") < least)
    return cut.withColumn("x0", F.when(bad, F.raise_error("crop is too small")).otherwise(F.col("x0")))


def calibrated(requests: DataFrame) -> DataFrame:
    """Scale and resolution from calibration requests ``(r0, scale, x1, y1, x2, y2, meters, px_per_mm)``.

    A circle's radius sets the resolution; a measured distance, where complete, sets the
    scale and takes precedence over a given one. Bad requests have a ``problem``.
    """
    ppm = F.when(F.col("r0") > 1, 2 * F.col("r0") / 6.0).otherwise(F.coalesce("px_per_mm", F.lit(6.0)))
    dist = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    some = F.col("x1").isNotNull() | F.col("x2").isNotNull() | F.col("meters").isNotNull()
    full = F.col("x1").isNotNull() & F.col("x2").isNotNull() & (F.col("meters") > 0) & (dist >= 1)
    measured = F.greatest(F.lit(1), F.bround(F.col("meters") / dist * ppm * 1000).cast("int"))
    problem = F.when(F.col("r0") <= 1, "radius is too small").when(some & ~F.coalesce(full, F.lit(False)), "measurement is incomplete").when(~some & (F.col("scale") < 1), "scale is not positive")
    return requests.withColumns({"px_per_mm": ppm, "scale": F.when(F.coalesce(full, F.lit(False)), measured).otherwise(F.col("scale")), "problem": problem})
