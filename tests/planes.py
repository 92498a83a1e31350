"""Small planes for the tests."""

import numpy as np


def plane(spark, labels, **flags):
    """A dense plane ``(map_id, y, x, label, ...)`` of arrays."""
    h, w = labels.shape
    names = list(flags)
    rows = [("m", y, x, int(labels[y, x]), *(bool(flags[n][y, x]) for n in names)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, ", ".join(["map_id string, y int, x int, label int", *(f"{n} boolean" for n in names)]))


def grid(df, column, shape):
    out = np.zeros(shape, dtype=object)
    for r in df.select("y", "x", column).collect():
        out[r[0], r[1]] = r[2]
    return out
