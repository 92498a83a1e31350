"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartospark.operators.graph import connected_components
from kartospark.sources.shared import checkpointed, written

__all__ = ["SLICE_BYTES", "WORD", "as_bytes", "checkpointed", "connected_components", "crc32_mod", "plain_names", "repeated", "run_starts", "slices", "table", "unused", "written"]

#: Words of every operator but benchmark decontamination: runs of anything but these six blanks,
#: which are also the bytes that ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at once inside a task, in bytes; keeps numpy scratch arrays small.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names, one for each stem, that ``df`` does not have, however it is called."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = next(n for i in range(len(taken) + 1) if (n := f"{stem}_{i}") not in taken)
        out.append(name)
        taken.add(name)
    return out


def plain_names(df: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns numbered, and the new names of ``cols``: names with dots or quotes in them need no care then."""
    names = [f"c{i}" for i in range(len(df.columns))]
    new = {c.lower(): n for c, n in zip(df.columns, names, strict=True)}
    return df.toDF(*names), [new[c.lower()] for c in cols]


def repeated(counted: DataFrame, n: str = "n", copy: str = "copy", chunk: int = 10_000) -> DataFrame:
    """``n`` rows for each row, numbered from 0 in ``copy``; made in chunks, so a huge ``n`` never is one array."""
    (low,) = unused(counted, "low")
    starts = counted.withColumn(low, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(chunk).cast("long"))))
    return starts.withColumn(copy, F.explode(F.sequence(low, F.least(F.col(low) + chunk, F.col(n)) - 1))).drop(low, n)


def crc32_mod(col: str, n: int) -> Column:
    """crc32 of the column's text form, modulo ``n``; null where the column is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of text (one long text may exceed it)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Positions where a sorted run of equal keys begins, closed by the length."""
    n = len(keys[0])
    new = np.ones(n + 1, dtype=bool)
    if n:
        new[1:n] = False
        for k in keys:
            new[1:n] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
