"""Colour expressions over columns of RGB values in 0..255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartospark.functions.maps import with_map_values


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def _linear(c: Column) -> Column:
    c = c / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of sRGB: L in 0..100."""
    r, g, b = _linear(r), _linear(g), _linear(b)
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    return light, 500.0 * (_f(x) - _f(y)), 200.0 * (_f(y) - _f(z))


def with_lab(df: DataFrame) -> DataFrame:
    """Adds ``l, a, lab_b`` from ``r, g, b``."""
    light, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    return df.withColumns({"l": light, "a": a, "lab_b": b})


def purple_score(a: Column, b: Column) -> Column:
    """0..1: how purple a colour is, from its Lab chroma."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (a - 0.5 * b - 10.0) / 50.0))


def white_balance(df: DataFrame, percentile: float = 95.0, least_pixels: int = 10) -> DataFrame:
    """Scale ``r, g, b`` so that the mean of each map's brightest pixels becomes white.

    Bright pixels are at or above the gray percentile; maps with fewer than
    ``least_pixels`` of them stay as they are. Results are cut to 0..255 and truncated.
    """
    g = gray(F.col("r"), F.col("g"), F.col("b"))
    cut = df.groupBy("map_id").agg(F.percentile(g, F.lit(percentile / 100.0)).alias("__cut"))
    bright = with_map_values(df, cut).where(g >= F.col("__cut") - 1e-9)  # interpolation may round up
    mean = bright.groupBy("map_id").agg(F.avg("r").alias("__r"), F.avg("g").alias("__g"), F.avg("b").alias("__b"), F.count(F.lit(1)).alias("__n"))

    def balanced(c: str) -> Column:
        gain = 255.0 / F.greatest(F.col(f"__{c}"), F.lit(1.0))
        scaled = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(c) * gain)))
        return F.when(F.col("__n") >= least_pixels, scaled).otherwise(F.col(c)).cast("int")

    return with_map_values(df, mean).withColumns({c: balanced(c) for c in "rgb"}).drop("__r", "__g", "__b", "__n")
