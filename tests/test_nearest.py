import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kartospark.operators import nearest


@given(st.dictionaries(st.integers(0, 40), st.tuples(st.integers(0, 12), st.integers(0, 3)), min_size=1, max_size=20))
@settings(max_examples=400, deadline=None)
def test_envelope_equals_the_least_of_all(sites):
    rows = [(x, g, row) for x, (g, row) in sorted(sites.items())]
    want = [min(((x - a) ** 2 + g * g, row, a) for a, g, row in rows) for x in range(41)]
    assert nearest.nearest_along(rows, list(range(41))) == want


def test_work_is_linear():
    """A row of 200 000 pixels with one target far away, and one where every column has one."""
    began = time.monotonic()
    n = 200_000
    assert nearest.nearest_along([(n - 1, 7, 3)], list(range(n)))[0] == ((n - 1) ** 2 + 49, 3, n - 1)
    every = nearest.nearest_along([(x, (x * 7919) % 1000, 0) for x in range(n)], list(range(n)))
    assert len(every) == n and time.monotonic() - began < 20


@pytest.mark.parametrize("share", [0.0, 0.002, 0.3, 1.0])
def test_nearest_equals_brute_force(spark, share):
    rng = np.random.default_rng(8)
    h, w = 23, 37
    on = rng.random((h, w)) < share
    ask = rng.random((h, w)) < 0.5
    df = spark.createDataFrame([("m", y, x, bool(on[y, x]), bool(ask[y, x])) for y in range(h) for x in range(w)], "map_id string, y int, x int, on boolean, ask boolean")
    got = sorted((r.y, r.x, r.d2, r.ny, r.nx) for r in nearest.nearest_set(df, "on", "ask").collect())
    ys, xs = np.nonzero(on)
    want = [(y, x, *min(((y - a) ** 2 + (x - b) ** 2, int(a), int(b)) for a, b in zip(ys, xs, strict=True))) for y in range(h) for x in range(w) if ask[y, x]] if on.any() else []
    assert got == want
