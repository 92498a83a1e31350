import numpy as np
import pytest
from pyspark.sql import functions as F

from kartospark.operators import areas, lines, nearest, stencil, terrain
from kartospark.settings import BEIGE, BLACK, BLUE, BROWN, GREY, PURPLE, UNKNOWN, WHITE
from planes import grid, plane


def test_single_unknown_takes_its_surroundings(spark):
    labels = np.full((5, 5), BEIGE)
    labels[2, 2] = UNKNOWN
    out = stencil.majority_fill(plane(spark, labels), "label", UNKNOWN)
    assert (grid(out, "label", (5, 5)) == BEIGE).all()


def test_reflected_border_counts_twice(spark):
    labels = np.array([[UNKNOWN, BLUE], [BLACK, BLACK]])
    out = stencil.majority_fill(plane(spark, labels), "label", UNKNOWN, 1, reflect=True)
    assert grid(out, "label", (2, 2))[0, 0] == BLACK


def test_purple_column_is_replaced(spark):
    labels = np.full((9, 9), GREY)
    labels[:, 4] = PURPLE
    assert (grid(areas.without_purple(plane(spark, labels)), "label", (9, 9)) == GREY).all()


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    on = rng.random((14, 19)) < 0.05
    on[3, 3] = True
    got = {(r.y, r.x): (r.d2, r.ny, r.nx) for r in nearest.nearest_set(plane(spark, np.zeros(on.shape, int), on=on), "on").collect()}
    ys, xs = np.nonzero(on)
    want = {(y, x): min(((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in zip(ys.tolist(), xs.tolist(), strict=True)) for y in range(14) for x in range(19)}
    assert got == want


def test_thin_water_is_passable(spark):
    labels = np.full((50, 50), WHITE)
    labels[:, 25] = BLUE
    labels[30:] = BLUE
    out = grid(terrain.water(plane(spark, labels), 6.0), "water", (50, 50))
    assert not out[:28].any() and out[32:].all()


def test_diagonal_leaks_close(spark):
    eye = np.eye(40, dtype=bool)
    out = grid(stencil.close_diagonals(plane(spark, eye.astype(int), m=eye), "m", "c"), "c", (40, 40))
    assert out.sum() == 79


def barrier_of(spark, labels):
    grey = labels == GREY
    return grid(lines.barriers(plane(spark, labels, building=grey), 6.0), "barrier", labels.shape)


def test_only_thick_lines_are_barriers(spark):
    labels = np.full((60, 90), WHITE)
    labels[20:24, 5:85] = BLACK
    labels[45, 5:85] = BLACK
    out = barrier_of(spark, labels)
    assert out[21:23, 10:80].all() and not out[40:].any()


def test_specks_and_outlines_are_no_barriers(spark):
    labels = np.full((60, 60), WHITE)
    labels[5:11, 5:10] = BLACK
    labels[25:55, 25:55] = BLACK
    labels[27:53, 27:53] = GREY
    assert not barrier_of(spark, labels).any()


def hatch_on_a_course(spacing):
    """A lattice at 6 px to the mm in a box, a circle on a line that touches it, and a digit with two holes."""
    purple = np.zeros((150, 230), bool)
    yy, xx = np.mgrid[:150, :230]
    step = max(4, round(spacing * 6))
    box = (slice(20, 121), slice(110, 211))
    for sign in (1, -1):
        purple[box] |= ((xx - sign * yy) % step < 2)[box]
    purple[np.abs(np.hypot(xx - 40, yy - 60) - 18) <= 1] = True
    purple[59:61, 58:112] = True
    purple[120:140, 30:34] = purple[120:140, 44:48] = True
    for y in (120, 129, 138):
        purple[y : y + 2, 30:48] = True
    truth = np.zeros(purple.shape, bool)
    truth[box] = True
    return purple, truth


@pytest.mark.parametrize("spacing", [1.0, 1.6, 2.4])
def test_hatch_of_any_spacing_is_found_by_its_components(spark, spacing):
    purple, truth = hatch_on_a_course(spacing)
    base = plane(spark, np.zeros(purple.shape, int), purple=purple)
    for least, found in ((0.75, areas.hatched_by_components(base, 6.0)), (0.8, areas.hatched(base, 6.0).where("hatch"))):
        out = np.zeros(purple.shape, bool)
        for r in found.select("y", "x").collect():
            out[r.y, r.x] = True
        assert (out & truth).sum() / (out | truth).sum() >= least
        assert not out[:, :95].any()


def test_no_hatch_on_a_plain_course(spark):
    purple, truth = hatch_on_a_course(1.6)
    purple &= ~truth
    base = plane(spark, np.zeros(purple.shape, int), purple=purple)
    assert areas.hatched(base, 6.0).where("hatch").count() == 0


def test_holes_are_those_of_one_component(spark):
    """A ring around another: the island counts as part of the outer one's hole, which has the area within its inner line."""
    mask = np.zeros((30, 30), bool)
    mask[2:20, 2:20] = True
    mask[4:18, 4:18] = False
    mask[8:13, 8:13] = True
    mask[10, 10] = False
    ys, xs = np.nonzero(mask)
    found = areas.enclosed(spark.createDataFrame([("m", int(y), int(x)) for y, x in zip(ys, xs, strict=True)], "map_id string, y int, x int"), 3)
    assert sorted(r["size"] for r in found.holes.collect()) == [2.0, 15.0**2 - 2]


def test_hatching_is_found(spark):
    purple = np.zeros((110, 130), bool)
    for k in range(-80, 200, 10):
        for y in range(25, 85):
            for x in (k + y, k + 110 - y):
                for d in (0, 1):
                    if 30 <= x + d < 100:
                        purple[y, x + d] = True
    purple[95, 5:125] = True
    out = grid(areas.hatched(plane(spark, np.zeros(purple.shape, int), purple=purple), 6.0), "hatch", purple.shape).astype(bool)
    want = np.zeros(purple.shape, bool)
    want[25:85, 30:100] = True
    assert (out & want).sum() / (out | want).sum() > 0.75


def test_paper_outside_the_map(spark):
    labels = np.full((70, 90), WHITE)
    labels[20:50, 20:70] = BEIGE
    labels[28:42, 30:60] = WHITE
    labels[35, 32:58] = BROWN
    labels[:, 10] = BLUE
    out = grid(areas.outside_map(plane(spark, labels), 2.0), "outside", labels.shape).astype(bool)
    assert out[5, 5] and out[60, 80] and not out[28:42, 30:60].any()


@pytest.mark.parametrize("angle", [0, 30, 45, 90])
@pytest.mark.parametrize("width", [2.0, 4.0])
def test_profile_widths_of_drawn_bars(spark, angle, width):
    """A soft-edged bar at any angle measures its width within half a pixel."""
    yy, xx = np.mgrid[:60, :60]
    turn = np.deg2rad(angle)
    across = (yy - 30) * np.cos(turn) - (xx - 30) * np.sin(turn)
    light = 90 - 80 * np.clip(width / 2 + 0.5 - np.abs(across), 0, 1)
    t = np.arange(-22, 22.1, 0.5)
    spots = sorted({(round(30 + k * np.sin(turn)), round(30 + k * np.cos(turn))) for k in t})
    skel = spark.createDataFrame([("m", int(y), int(x)) for y, x in spots], "map_id string, y int, x int")
    plane_ = spark.createDataFrame([("m", y, x, float(light[y, x])) for y in range(60) for x in range(60)], "map_id string, y int, x int, l double")
    got = [r.width for r in lines.profile_widths(skel, plane_).collect()]
    assert len(got) == len(spots) and abs(np.median(got) - width) <= 0.5


def test_blurred_wall_is_a_barrier_by_its_profile(spark):
    """A wall whose soft edges are not black is too thin by area; its lightness tells."""
    labels = np.full((40, 60), WHITE)
    labels[20, 5:55] = BLACK
    labels[32, 5:55] = BLACK
    light = np.full((40, 60), 90.0)
    light[18:23, 5:55] = 40
    light[20, 5:55] = 10
    light[32, 5:55] = 10
    base = plane(spark, labels, building=np.zeros(labels.shape, bool))
    soft = spark.createDataFrame([("m", y, x, float(light[y, x])) for y in range(40) for x in range(60)], "map_id string, y int, x int, l double")
    assert not grid(lines.barriers(base, 6.0), "barrier", labels.shape).any()
    got = grid(lines.barriers(base, 6.0, light=soft), "barrier", labels.shape).astype(bool)
    assert got[20, 8:52].all() and not got[32].any()


def test_junction_pixels_go_to_the_nearest_segment(spark):
    """Pixels nearest to a junction belong to a segment all the same; areas add up to the mask."""
    on = np.zeros((31, 31), bool)
    on[13:18, 3:28] = True
    on[3:28, 13:18] = True
    thin = lines.skeleton(plane(spark, on.astype(int), on=on), "on")
    segments = lines.stroke_segments(thin)
    owner = lines.owners(thin, "on", "skel", segments)
    assert owner.where("seg is null").count() == 0 and owner.count() == on.sum()
    assert sum(r.area for r in lines.segment_widths(owner, segments).collect()) == on.sum()


def test_skeleton_of_a_bar(spark):
    on = np.zeros((15, 40), bool)
    on[5:10, 4:36] = True
    out = grid(lines.skeleton(plane(spark, on.astype(int), on=on), "on"), "skel", on.shape).astype(bool)
    assert out.any() and not (out & ~on).any() and out[:, 10:30].sum(axis=0).tolist() == [1] * 20


def test_narrow_passage_stays_open_and_wall_shut(spark):
    labels = np.full((60, 60), WHITE)
    labels[:, 20:40] = GREY
    labels[28:31, 20:40] = WHITE
    none = np.zeros(labels.shape, bool)
    cells = terrain.cost_cells(plane(spark, labels, forbidden=labels == GREY, barrier=none), 4)
    assert cells.where((F.col("r") == 7) & (F.col("cost") < float("inf"))).count() == 15
    wall = none.copy()
    wall[:, 30] = True
    shut = terrain.cost_cells(plane(spark, np.full((60, 60), WHITE), forbidden=none, barrier=wall), 4)
    assert shut.where((F.col("c") == 7) & (F.col("cost") == float("inf"))).count() == 15


def test_allow_wins_over_forbid(spark):
    labels = np.full((20, 20), WHITE)
    none = np.zeros(labels.shape, bool)
    df = plane(spark, labels, forbidden=none, barrier=~none)
    rows = [("m", "a", "forbid", [(2.0, 2.0), (12.0, 2.0), (12.0, 12.0), (2.0, 12.0)]), ("m", "b", "allow", [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]), ("m", "c", "allow", [(0.0, 0.0), (1.0, 1.0)])]
    edits = spark.createDataFrame(rows, "map_id string, edit_id string, kind string, points array<struct<x:double,y:double>>")
    out = terrain.apply_edits(df, terrain.polygon_pixels(df, edits), ["forbidden", "barrier"])
    forbidden, barrier = grid(out, "forbidden", (20, 20)), grid(out, "barrier", (20, 20))
    assert forbidden.sum() == 121 - 9 and not forbidden[4:7, 4:7].any() and not barrier[4:7, 4:7].any() and barrier.sum() == 400 - 9


def test_edited_cells_equal_a_full_run(spark):
    """Edits added, moved, changed in kind and taken away, next to each other, at the border and beyond it."""
    rng = np.random.default_rng(11)
    labels = rng.choice([BEIGE, WHITE, BROWN], (50, 60))
    base = plane(spark, labels, forbidden=rng.random(labels.shape) < 0.2, barrier=rng.random(labels.shape) < 0.01)
    schema = "map_id string, edit_id string, kind string, points array<struct<x:double,y:double>>"

    def box(i, kind, x, y, w, h):
        return ("m", i, kind, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])

    stays = box("a", "forbid", 5.0, 5.0, 8.0, 8.0)
    before = spark.createDataFrame([stays, box("b", "allow", 20.0, 30.0, 6.0, 5.0), box("c", "forbid", 40.0, 10.0, 3.0, 3.0), ("m", "d", "forbid", [(1.0, 1.0), (2.0, 2.0)])], schema)
    after = spark.createDataFrame([stays, box("b", "forbid", 20.0, 30.0, 6.0, 5.0), box("e", "allow", 55.0, 44.0, 30.0, 30.0), box("f", "forbid", 28.0, 30.0, 2.0, 2.0)], schema)

    def full(edits):
        return terrain.cost_cells(terrain.apply_edits(base, terrain.polygon_pixels(base, edits), ["forbidden", "barrier"]), 3)

    got = terrain.edited_cells(base, full(before), before, after, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full(after).collect()))
    assert terrain.edited_cells(base, full(before), before, before, 3).count() == 17 * 20
