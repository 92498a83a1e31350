import numpy as np
from pyspark.sql import functions as F

from kartospark.operators import course, rings
from kartospark.operators.bins import within


def test_pairs_within_reach_are_found_once(spark):
    rng = np.random.default_rng(2)
    a = [(int(m), i, float(x), float(y)) for i, (m, x, y) in enumerate(zip(rng.integers(0, 2, 300), rng.uniform(-50, 200, 300), rng.uniform(-50, 200, 300), strict=True))]
    b = [(int(m), i, float(x), float(y), float(w), float(r)) for i, (m, x, y, w, r) in enumerate(zip(rng.integers(0, 2, 200), rng.uniform(-50, 200, 200), rng.uniform(-50, 200, 200), rng.uniform(0, 40, 200), rng.choice([0.0, 0.3, 1, 7, 64, 65], 200), strict=True))]
    points, boxes = spark.createDataFrame(a, "map_id int, p int, px double, py double"), spark.createDataFrame(b, "map_id int, q int, bx double, b_y double, w double, r double")
    met = within(points, boxes, ("px", "py"), (F.col("bx"), F.col("bx") + F.col("w")), (F.col("b_y"), F.col("b_y")), F.col("r"))
    gap = F.hypot(F.greatest(F.col("bx") - F.col("px"), F.lit(0.0), F.col("px") - F.col("bx") - F.col("w")), F.col("py") - F.col("b_y"))
    got = sorted((r.p, r.q) for r in met.where(gap <= F.col("r")).collect())
    want = sorted((p, q) for m, p, x, y in a for n, q, bx, by, w, r in b if m == n and np.hypot(max(bx - x, 0, x - bx - w), y - by) <= r)
    assert got == want


def test_one_map_of_many_circles(spark):
    """100 000 candidates on one map: suppression, radius, distance and labels meet on grids, so it ends."""
    n = 100_000
    circles = spark.range(n).select(F.lit("m").alias("map_id"), F.col("id").alias("cid"), (F.rand(1) * 30_000).alias("cx"), (F.rand(2) * 30_000).alias("cy"), F.floor(F.rand(3) * 20 + 5).cast("double").alias("cr"), F.rand(4).alias("support"))
    circles = circles.persist()
    kept = rings.suppressed(circles).persist()
    assert n // 4 < kept.count() < n
    r0 = rings.radius_consensus(circles).first()
    per = {r.cr: (r.s, r.k) for r in circles.groupBy("cr").agg(F.sum("support").alias("s"), F.count(F.lit(1)).alias("k")).collect()}
    near = {a: [b for b in per if abs(b - a) <= 0.08 * a] for a in per}
    best = near[max(near, key=lambda a: sum(per[b][0] for b in near[a]))]
    assert r0.n == sum(per[b][1] for b in best)
    assert abs(r0.r0 - sum(b * per[b][0] for b in best) / sum(per[b][0] for b in best)) < 1e-6
    others = circles.where("cid < 1000").select("map_id", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    assert rings.away_from(circles, others, F.col("cr")).count() < n - 1000
    boxes = circles.where("cid < 20000").select("map_id", F.col("cid").alias("lid"), F.col("cx").alias("x0"), F.col("cy").alias("y0"), (F.col("cx") + 9).alias("x1"), (F.col("cy") + 5).alias("y1"))
    spots = circles.select("map_id", F.col("cid").alias("node"), "cx", "cy")
    assert course.label_candidates(boxes, spots, F.lit(10.0)).where("lid = node").count() == 20_000
    circles.unpersist()
