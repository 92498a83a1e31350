import numpy as np
import pytest
from pyspark.sql import functions as F

from kartospark.plans import analysis
from kartospark.settings import BEIGE, GREY, PURPLE, REFERENCE_COLORS, WHITE, Settings
from kartospark.sources import images, projects
from kartospark.streaming import scans

COLORS = {WHITE: REFERENCE_COLORS["WHITE"][1], BEIGE: REFERENCE_COLORS["BEIGE"][0], GREY: REFERENCE_COLORS["GREY"][0]}


def small_map():
    labels = np.full((48, 64), BEIGE)
    labels[10:38, 28:36] = GREY
    labels[:, :6] = WHITE
    return labels


def pixels(spark, labels, map_id="m"):
    rows = [(map_id, y, x, *COLORS[int(labels[y, x])]) for y in range(labels.shape[0]) for x in range(labels.shape[1])]
    return spark.createDataFrame(rows, "map_id string, y int, x int, r int, g int, b int")


def test_map_to_routes(spark):
    truth = small_map()
    labels = analysis.segmentation(pixels(spark, truth))
    got = {(r.y, r.x): r.label for r in labels.collect()}
    assert np.mean([got[y, x] == truth[y, x] for y in range(48) for x in range(64)]) > 0.98
    cfg = Settings(outside_map_enabled=False, hatch_enabled=False)
    planes = analysis.terrain_planes(labels, 4.0, cfg)
    forbidden = {(r.y, r.x) for r in planes.where("forbidden").collect()}
    assert {(y, x) for y in range(12, 36) for x in range(29, 35)} <= forbidden and (5, 40) not in forbidden
    cells = analysis.cost_grid(planes, 4.0, cfg=cfg)
    controls = spark.createDataFrame([("m", 1, 0, 10.0, 24.0), ("m", 2, 1, 55.0, 24.0)], "map_id string, id int, order int, x double, y double")
    leg = analysis.routes(controls, cells, 1, 4.0, cfg=cfg).first()
    assert leg.ok and leg.length_px > 46 and all((int(p.y), int(p.x)) not in forbidden for p in leg.path)
    wall = [("m", "w", "forbid", [(27.0, 0.0), (37.0, 0.0), (37.0, 47.0), (27.0, 47.0)])]
    edits = spark.createDataFrame(wall, "map_id string, edit_id string, kind string, points array<struct<x:double,y:double>>")
    blocked = analysis.routes(controls, analysis.cost_grid(planes, 4.0, edits, cfg), 1, 4.0, cfg=cfg).first()
    assert not blocked.ok and blocked.cost == -1


def test_png_round_trip(spark, tmp_path):
    labels = small_map()[:12, :40]
    shown = pixels(spark, labels).select(F.lit("a").alias("name"), "y", "x", "r", "g", "b", F.lit(255).alias("alpha"))
    size = spark.createDataFrame([("a", 12, 41)], "name string, height int, width int")
    (row,) = images.png_files(shown.where("x < 40"), size).collect()
    (tmp_path / "a.png").write_bytes(row.content)
    (tmp_path / "b.png").write_bytes(b"no picture")
    back = {(r.y, r.x): (r.r, r.g, r.b) for r in images.read_pixels(spark, str(tmp_path)).collect()}
    assert len(back) == 12 * 41 and all(back[y, x] == COLORS[int(labels[y, x])] for y in range(12) for x in range(40))
    assert images.scan_files(spark, str(tmp_path)).count() == 2


def test_ingest_tells_bad_files_apart(spark, tmp_path):
    shown = pixels(spark, small_map()[:12, :40]).select(F.lit("a").alias("name"), "y", "x", "r", "g", "b", F.lit(255).alias("alpha"))
    (row,) = images.png_files(shown, spark.createDataFrame([("a", 12, 40)], "name string, height int, width int")).collect()
    for name, content in {"a.png": row.content, "b.PNG": row.content, "cut.png": row.content[:60], "text.jpg": b"no picture", "notes.txt": b"words"}.items():
        (tmp_path / name).write_bytes(content)
    good, bad = images.ingested(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.width, r.height, r.image_file, len(r.project_id)) for r in good.collect()) == [("a.png", 40, 12, "original.png", 12), ("b.PNG", 40, 12, "original.png", 12)]
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in bad.collect()} == {"cut.png": "could not be decoded", "text.jpg": "could not be decoded", "notes.txt": "unsupported type"}
    bodies = [("1", '{"project_id": "abcdef12", "version": 2, "name": "x"}'), ("2", '{"project_id": "abcdef12", "version": 3'), ("3", "[]"), ("4", '{"version": 1}'), ("5", '{"project_id": "abcdef13"}'), ("6", None), ("7", "")]
    good, bad = projects.documents(spark.createDataFrame(bodies, "path string, body string"))
    assert [(r.project_id, r.version) for r in projects.latest(good).collect()] == [("abcdef12", 2)]
    assert sorted(r.path for r in bad.collect()) == ["2", "3", "4", "5", "6", "7"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "projects")
    for version, name in ((1, "old"), (2, "new")):
        projects.save(spark.createDataFrame([("abcdef12", version, name)], "project_id string, version long, name string"), path)
    assert projects.load(spark, path, "abcdef12").first().name == "new"
    with pytest.raises(projects.ProjectNotFound):
        projects.load(spark, path, "00000000")
    made = []
    for _ in range(2):
        got = projects.stored(spark, str(tmp_path / "cache"), "k1", lambda: made.append(1) or spark.range(3))
    assert got.count() == 3 and made == [1]


def test_calibration_and_crop(spark):
    columns = "r0 double, scale int, x1 double, y1 double, x2 double, y2 double, meters double, px_per_mm double"
    rows = [(18.0, 4000, None, None, None, None, None, None), (None, 4000, 0.0, 0.0, 60.0, 0.0, 40.0, 6.0), (None, 4000, 0.0, 0.0, None, None, 5.0, 6.0), (None, -1, None, None, None, None, None, 6.0), (0.5, 10, None, None, None, None, None, None)]
    got = projects.calibrated(spark.createDataFrame(rows, columns)).collect()
    assert [(g.px_per_mm, g.scale, g.problem is None) for g in got] == [(6.0, 4000, True), (6.0, 4000, True), (6.0, 4000, False), (6.0, -1, False), (6.0, 10, False)]
    crop = spark.createDataFrame([(90, 70, -5, 20, 80, 60)], "x0 int, y0 int, x1 int, y1 int, width int, height int")
    assert tuple(projects.clamped_crop(crop).first())[:4] == (0, 20, 80, 60)


def test_stream_of_maps(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    pixels(spark, small_map()[:20, :20], "one").coalesce(1).write.parquet(source)
    cfg = Settings(outside_map_enabled=False, hatch_enabled=False)
    scans.run(scans.pixel_stream(spark, source), out, str(tmp_path / "state"), 4.0, cfg).awaitTermination()
    assert spark.read.parquet(out).where("map_id = 'one'").count() == 400


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("KARTO_CELL_MM", "0.5")
    monkeypatch.setenv("KARTO_HATCH_ENABLED", "false")
    cfg = Settings.from_env()
    assert cfg.cell_mm == 0.5 and cfg.hatch_enabled is False


START = (220, 175)


def drawn_course():
    """A synthetic overprint: circles of one size joined by lines, a finish of two rings, and two labels; with its truth."""
    labels = np.full((200, 260), WHITE)
    yy, xx = np.mgrid[:200, :260]
    points = [(40, 45), (95, 40), (150, 60), (205, 45), (210, 120), (140, 130)]
    finish, r = (60, 140), 15

    def ring(x, y, radius):
        labels[np.abs(np.hypot(xx - x, yy - y) - radius) <= 1.2] = PURPLE

    for x, y in points:
        ring(x, y, r)
    side, (sx, sy) = r * 7 / 3, START
    corners = [(sx + side / 3**0.5 * np.cos(np.deg2rad(a)), sy + side / 3**0.5 * np.sin(np.deg2rad(a))) for a in (-60, 60, 180)]
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        for t in np.linspace(0, 1, 200):
            x, y = round(ax + (bx - ax) * t), round(ay + (by - ay) * t)
            labels[y : y + 2, x : x + 2] = PURPLE
    ring(*finish, r * 5 / 6)
    ring(*finish, r * 7 / 6)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], finish], strict=True):
        d = np.hypot(bx - ax, by - ay)
        last = d - r * (7 / 6 if (bx, by) == finish else 1) - 3
        for t in np.arange(r + 3, last, 0.5):
            x, y = ax + (bx - ax) * t / d, ay + (by - ay) * t / d
            labels[round(y), round(x)] = labels[round(y) + 1, round(x)] = PURPLE
    return labels, points, finish, r


def test_course_is_detected(spark):
    labels, points, finish, r = drawn_course()
    other = np.full((60, 60), WHITE)  # a map without a course has no rows
    rows = [(m, y, x, int(a[y, x])) for m, a in (("m", labels), ("n", other)) for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "map_id string, y int, x int, label int")
    texts = spark.createDataFrame([("m", i, x + 20, y - 6, x + 30, y + 6, f"{i + 1}-{101 + i}") for i, (x, y) in enumerate(points) if i != 2], "map_id string, lid int, x0 int, y0 int, x1 int, y1 int, text string")
    found = analysis.detection(df, texts, known=spark.createDataFrame([("k", 9.0)], "map_id string, r0 double"))
    (row,) = found.r0.collect()
    assert row.map_id == "m" and abs(row.r0 - r) < 0.1 * r
    nodes = found.nodes.collect()
    controls = [n for n in nodes if n.kind == "control"]
    near = [min(np.hypot(n.x - x, n.y - y) for n in controls) for x, y in points]
    assert sum(d < 3 for d in near) >= 0.9 * len(points) and len(controls) <= len(points) + 1
    (end,) = [n for n in nodes if n.kind == "finish"]
    assert np.hypot(end.x - finish[0], end.y - finish[1]) < 3
    (begin,) = [n for n in nodes if n.kind == "start"]
    assert np.hypot(begin.x - START[0], begin.y - START[1]) < 3 and abs(begin.r - r * 7 / 3 / 3**0.5) < 4
    controls = found.controls.collect()
    assert sorted(c.code for c in controls if c.code is not None) == [101, 102, 104, 105, 106]
    told = {(m.map_id, m.name) for m in found.messages.collect()}
    assert ("n", "no_scale") in told and not {n for m, n in told if m == "m"} & {"no_scale", "no_start", "no_finish", "incomplete", "numbers_unclear"}
    scales = {s.map_id: (s.px_per_mm, s.source) for s in found.px_per_mm.collect()}
    assert scales["n"] == (6.0, "default") and scales["m"] == (pytest.approx(2 * row.r0 / 6), "auto")
    order = sorted((c.order, c.x, c.y) for c in controls if c.order is not None and c.kind != "start")
    assert len(order) == 7 and all(np.hypot(x - px, y - py) < 3 for (_, x, y), (px, py) in zip(order, [*points, finish], strict=True))


def test_lines_of_text_are_boxed_for_a_reader(spark):
    """Two bars beside a circle are one line of text; rings, legs and the start are none. Score finds a third bar."""
    labels, points, finish, r = drawn_course()
    score = np.zeros(labels.shape)
    labels[64:75, 12:15] = labels[64:75, 18:22] = PURPLE
    score[64:75, 25:28] = 0.9
    kinds = [("control", x, y, r) for x, y in points] + [("finish", *finish, r * 7 / 6), ("start", *START, r * 7 / 3 / 3**0.5)]
    nodes = spark.createDataFrame([("m", i, kind, float(x), float(y), float(size)) for i, (kind, x, y, size) in enumerate(kinds)], "map_id string, node int, kind string, x double, y double, r double")
    r0 = spark.createDataFrame([("m", float(r))], "map_id string, r0 double")
    found = analysis.Detection(r0, nodes, None, None, None)
    df = spark.createDataFrame([("m", y, x, int(labels[y, x]), float(score[y, x])) for y in range(labels.shape[0]) for x in range(labels.shape[1])], "map_id string, y int, x int, label int, purple_score double")
    boxes = [(b.x0, b.y0, b.x1, b.y1, b.n) for b in analysis.label_boxes(found, df.drop("purple_score")).collect()]
    assert boxes == [(12, 64, 22, 75, 2)]
    assert [(b.x0, b.x1, b.n) for b in analysis.label_boxes(found, df).collect()] == [(12, 28, 3)]


def test_maps_run_at_their_own_scale(spark):
    scales = spark.createDataFrame([("a", 5.0), ("b", 5.01), ("c", 9.0), ("d", None), ("e", 0.0)], "map_id string, px_per_mm double")
    runs = []

    def run(maps, px_per_mm):
        runs.append(px_per_mm)
        return maps.withColumn("at", F.lit(px_per_mm))

    assert sorted((r.map_id, round(r["at"], 6)) for r in analysis.at_own_scale(scales, run).collect()) == [("a", 5.0), ("b", 5.0), ("c", 9.0)]
    assert len(runs) == 2 and analysis.at_own_scale(scales.limit(0), run).collect() == []


def test_known_radius_goes_first(spark):
    """A map whose radius a user has marked is searched at that size, though too few circles agree on one."""
    labels = np.full((110, 130), WHITE)
    yy, xx = np.mgrid[:110, :130]
    for x, y in ((35, 40), (90, 60)):
        labels[np.abs(np.hypot(xx - x, yy - y) - 14) <= 1.2] = PURPLE
    df = spark.createDataFrame([("k", y, x, int(labels[y, x])) for y in range(110) for x in range(130)], "map_id string, y int, x int, label int")
    starts = spark.createDataFrame([], "map_id string, cx double, cy double, r double")
    found = analysis.detection(df, starts=starts, known=spark.createDataFrame([("k", 14.0)], "map_id string, r0 double"))
    assert [(r.px_per_mm, r.source) for r in found.px_per_mm.collect()] == [(pytest.approx(28 / 6), "user")]
    assert sorted(round(n.x / 5) * 5 for n in found.nodes.collect() if n.kind == "control") == [35, 90]
    assert {m.name for m in found.messages.collect()} >= {"no_start", "no_finish", "incomplete"}


def test_maps_are_analysed_to_layers(spark, tmp_path):
    cfg = Settings(outside_map_enabled=False, hatch_enabled=False)
    planes, cells = analysis.analysed(pixels(spark, small_map()[:24, :40]), str(tmp_path), 4.0, cfg=cfg)
    assert {p.name for p in tmp_path.glob("*.png")} == {f"m-{n}.png" for n in analysis.LAYERS}
    shown = images.read_pixels(spark, str(tmp_path / "m-labels.png"))
    assert shown.count() == planes.count() == 960 and cells.count() > 0
