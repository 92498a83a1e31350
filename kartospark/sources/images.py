"""Scans in, rendered layers out."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: file types of scans.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``(map_id, path, modified, sha, content)`` of image files; the id is twelve digits of the content's sha256."""
    files = spark.read.format("binaryFile").load(path)
    sha = F.sha2("content", 256)
    wanted = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).isin(list(EXTENSIONS))
    return files.where(wanted).select(F.substring(sha, 1, 12).alias("map_id"), "path", F.col("modificationTime").alias("modified"), sha.alias("sha"), "content")


#: Pixels that a task passes on at once.
_AT_ONCE = 1 << 18


def _pixel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels of rows ``(origin, y, channels, line)``, many rows together."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("origin", "y", "channels", "line")), strict=True)
        origins, ys, xs, colors, size = [], [], [], [], 0
        for origin, y, channels, line in rows:
            there = np.frombuffer(line, dtype=np.uint8).reshape(-1, channels)[:, 2::-1]
            origins.append(origin)
            ys.append(y)
            xs.append(len(there))
            colors.append(there)
            size += len(there)
            if size >= _AT_ONCE:
                yield _pixel_batch(origins, ys, xs, colors)
                origins, ys, xs, colors, size = [], [], [], [], 0
        if size:
            yield _pixel_batch(origins, ys, xs, colors)


def _pixel_batch(origins: list[str], ys: list[int], widths: list[int], colors: list[np.ndarray]) -> pa.RecordBatch:
    row, every = np.repeat(np.arange(len(ys)), widths), np.concatenate(colors).astype(np.int32)
    x = np.concatenate([np.arange(w, dtype=np.int32) for w in widths])
    parts = [pa.array(origins, type=pa.string()).take(pa.array(row)), pa.array(np.array(ys, dtype=np.int32)[row]), pa.array(x), *[pa.array(np.ascontiguousarray(every[:, i])) for i in range(3)]]
    return pa.RecordBatch.from_arrays(parts, names=["origin", "y", "x", "r", "g", "b"])


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``(origin, y, x, r, g, b)`` of every pixel of decodable images below ``path``; others are skipped.

    Bytes are blue, green, red (and alpha), row by row; rows of pixels are cut out and
    each is decoded once, as an array.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("nChannels >= 3")
    width = F.col("width") * F.col("nChannels")
    rows = images.select("origin", F.col("nChannels").alias("channels"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substring("data", y * width + 1, width))).alias("y", "line"))
    return rows.mapInArrow(_pixel_batches, "origin string, y int, x int, r int, g int, b int")


def ingested(spark: SparkSession, path: str, scale: int = 4000) -> tuple[DataFrame, DataFrame]:
    """New projects of the pictures below ``path``, and the files that are none.

    Projects are ``(project_id, version, image_file, path, sha, width, height, scale,
    modified)``, the id twelve digits of the content's sha256, version 1. Rejects are
    ``(path, sha, reason)``: a type that is no scan's, or a file that does not decode, such
    as a truncated one. Every file is in one of the two, but for files without a byte,
    which Spark's file sources do not list. Pictures are decoded in the tasks; of their
    content only the hash and the size are passed on.
    """
    kind = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha"), F.col("modificationTime").alias("modified"), kind.alias("kind"))
    sizes = spark.read.format("image").option("dropInvalid", False).load(path).select(F.col("image.origin").alias("origin"), "image.width", "image.height", "image.nChannels")
    reason = F.when(~F.col("kind").isin(list(EXTENSIONS)), "unsupported type").when(F.coalesce("nChannels", F.lit(-1)) < 1, "could not be decoded")

    def plain(c: str):
        """The sources write the slashes after a scheme differently."""
        return F.regexp_replace(c, r"^([a-z0-9]+:)/+", "$1/")

    told = files.join(sizes, plain("path") == plain("origin"), "left").withColumn("reason", reason)
    good = told.where("reason is null").select(F.substring("sha", 1, 12).alias("project_id"), F.lit(1).cast("long").alias("version"), F.concat(F.lit("original"), F.col("kind")).alias("image_file"), "path", "sha", "width", "height", F.lit(scale).alias("scale"), "modified")
    return good, told.where("reason is not null").select("path", "sha", "reason")


def _png_rows(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Filtered scan lines of PNG files, one for each row of pixels."""
    for row in rows:
        lines = [b"\0" + np.array(p, dtype=np.uint8).tobytes() for p in row["rgba"]]
        yield pd.DataFrame({"name": row["name"], "y": row["y"], "width": row["width"], "line": lines})


def png(header: tuple[int, int], lines: list[bytes]) -> bytes:
    """An RGBA PNG file of filtered scan lines."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    width, height = header
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines), 6)) + chunk(b"IEND", b"")


def layer_rows(layer: DataFrame, size: DataFrame) -> DataFrame:
    """``(name, y, width, line)``: PNG scan lines of layers ``(name, y, x, r, g, b, alpha)`` on ``(name, height, width)`` canvases.

    Pixels without a row are transparent.
    """
    there = layer.groupBy("name", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", F.array("r", "g", "b", "alpha").alias("c")))).alias("m"))
    rows = size.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).join(there, ["name", "y"], "left")
    empty = F.array(*[F.lit(0)] * 4)
    rgba = F.flatten(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.coalesce(F.try_element_at(F.col("m"), x), empty)))
    return rows.select("name", "y", "width", rgba.alias("rgba")).mapInPandas(_png_rows, "name string, y int, width int, line binary")


def png_files(layer: DataFrame, size: DataFrame) -> DataFrame:
    """``(name, content)``: one PNG a layer; a picture is as large as one scan, so it is one row."""

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("y")
        return pd.DataFrame({"name": [rows["name"].iloc[0]], "content": [png((int(rows["width"].iloc[0]), len(rows)), list(rows["line"]))]})

    return layer_rows(layer, size).groupBy("name").applyInPandas(put_together, "name string, content binary")


def _store_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, base = fs.FileSystem.from_uri(folder)
    for batch in batches:
        names = batch.column("name").to_pylist()
        for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
            aside = f"{base}/_{uuid.uuid4().hex}"
            with files.open_output_stream(aside) as out:
                out.write(content)
            files.move(aside, f"{base}/{name}.png")
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, type=pa.string())})


def write_pngs(files: DataFrame, folder: str) -> int:
    """Store ``(name, content)`` as ``folder/<name>.png`` and return how many.

    The tasks that hold the pictures write them, aside first and then moved into place,
    so a task that runs again leaves the same files. ``folder`` is a URI of a store that
    all executors share and that Arrow can reach.
    """
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    where, base = fs.FileSystem.from_uri(uri)
    where.create_dir(base)
    return files.select("name", "content").mapInArrow(partial(_store_batches, folder=uri), "name string").count()
