"""The stages put together: segmentation, terrain, cost grid, course detection and routes, for all maps at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartospark.functions.color import purple_score, white_balance, with_lab
from kartospark.operators import areas, classify, course, graph, lines, nearest, rings, routing, stencil, terrain, triangles
from kartospark.settings import PURPLE, UNKNOWN, Settings
from kartospark.sources import images
from kartospark.sources.shared import written

# Layers of single masks, by name: the mask's column and its colour.
MASK_LAYERS = {
    "forbidden": ("forbidden", (230, 0, 0, 170)),
    "outside": ("outside", (90, 90, 90, 170)),
    "purple": ("purple", (200, 0, 200, 255)),
    "hatch": ("hatch", (255, 120, 0, 200)),
    "barriers": ("barrier", (0, 60, 255, 255)),
}
LAYERS = ("labels", *MASK_LAYERS, "cost")


def segmentation(pixels: DataFrame, cfg: Settings | None = None, samples: DataFrame | None = None) -> DataFrame:
    """``(map_id, y, x, label)`` from ``(map_id, y, x, r, g, b)``: white balance, nearest reference colour, gaps filled.

    ``samples`` is ``(map_id, class_name, sx, sy)``, clicked points whose colours replace
    a class's defaults.
    """
    cfg = cfg or Settings()
    balanced = white_balance(pixels, cfg.white_percentile)
    own = classify.sample_references(balanced, samples, cfg.sample_patch_px) if samples is not None else None
    refs = classify.references(pixels.select("map_id").distinct(), own)
    labelled = written(classify.segment(balanced, refs, cfg).select("map_id", "y", "x", "label"))
    return written(stencil.majority_fill(labelled, "label", UNKNOWN, cfg.unknown_fill_iterations, reflect=True))


def segmented(pixels: DataFrame, cfg: Settings | None = None, samples: DataFrame | None = None) -> DataFrame:
    """``(map_id, y, x, label, l, purple_score)``: classes of smoothed and balanced pixels, with their lightness and how purple they are."""
    cfg = cfg or Settings()
    smooth = written(stencil.bilateral(pixels, cfg.bilateral_sigma_space, cfg.bilateral_sigma_color))
    lab = with_lab(white_balance(smooth, cfg.white_percentile))
    shown = lab.select("map_id", "y", "x", F.col("l").cast("float").alias("l"), purple_score(F.col("a"), F.col("lab_b")).cast("float").alias("purple_score"))
    return segmentation(smooth, cfg, samples).join(shown, ["map_id", "y", "x"])


def terrain_planes(labels: DataFrame, px_per_mm: float, cfg: Settings | None = None, light: DataFrame | None = None) -> DataFrame:
    """``(map_id, y, x, label, purple, hatch, outside, outline, water, barrier, forbidden)``; with ``light`` (``map_id, y, x, l``) strokes are measured by their profiles too."""
    cfg = cfg or Settings()
    plane = labels.select("map_id", "y", "x", "label").withColumn("purple", F.col("label") == PURPLE)
    plane = written(areas.without_purple(plane, cfg.purple_dilate_px))
    plane = areas.hatched(plane, px_per_mm, cfg) if cfg.hatch_enabled else plane.withColumn("hatch", F.lit(False))
    plane = written(terrain.buildings(written(plane), px_per_mm, cfg))
    plane = written(lines.barriers(plane, px_per_mm, cfg, light))
    plane = areas.outside_map(plane, px_per_mm, cfg) if cfg.outside_map_enabled else plane.withColumn("outside", F.lit(False))
    plane = terrain.water(terrain.outlines(written(plane)), px_per_mm, cfg)
    return written(plane.withColumn("forbidden", terrain.forbidden()).select("map_id", "y", "x", "label", "purple", "hatch", "outside", "outline", "water", "barrier", "forbidden"))


def cost_grid(planes: DataFrame, px_per_mm: float, edits: DataFrame | None = None, cfg: Settings | None = None, origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """``(map_id, r, c, cost, barrier)``, with user edits ``(map_id, edit_id, kind, points)`` on top of the terrain."""
    cfg = cfg or Settings()
    if edits is not None:
        planes = terrain.apply_edits(planes, terrain.polygon_pixels(planes, edits, origin), ["forbidden", "barrier"])
    return written(terrain.cost_cells(planes, terrain.cell_size(px_per_mm, cfg), cfg))


def strength(order: DataFrame, support: DataFrame, out: str = "strength") -> DataFrame:
    """``(map_id, strength)``: mean line support of the steps of ``(map_id, order)``; a step without a line counts as 0, a course without steps has no row."""
    w = Window.partitionBy("map_id").orderBy("pos")
    i, j = F.col("node"), F.lead("node").over(w)
    steps = order.where("order is not null").select("map_id", F.posexplode("order").alias("pos", "node")).select("map_id", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), j.alias("next")).where("next is not null")
    return steps.join(support, ["map_id", "i", "j"], "left").groupBy("map_id").agg(F.round(F.avg(F.coalesce("support", F.lit(0.0))), 9).alias(out))


# What a detection may have to tell of a map, by the name that its message goes by.
MESSAGES = {
    "no_scale": "no circles agree on a size; the default resolution is used until a circle is marked by hand",
    "no_start": "no start triangle was found",
    "no_finish": "no finish of two rings was found",
    "lines_taken": "numbers and lines tell different courses; the lines are stronger and were followed",
    "numbers_taken": "numbers and lines tell different courses; the numbers were followed",
    "numbers_inferred": "some numbers could not be read and were filled in from the lines",
    "numbers_unclear": "the numbers that were read do not tell the course",
    "incomplete": "the lines do not join all symbols; the rest must be ordered by hand",
}


def course_choice(nodes: DataFrame, mask: DataFrame, labels: DataFrame, r0: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """``(map_id, order, notes)``: each map's course as an array of nodes, by printed numbers or by lines, and names of ``MESSAGES`` on how it came about.

    ``nodes`` is ``(map_id, node, kind, x, y, r)``; ``labels`` ``(map_id, node, orders)``;
    ``r0`` ``(map_id, r0)``. Where both tell a whole course and differ, that whose lines
    are stronger in the mean is taken, the numbers' if they are equal.
    """
    cfg = cfg or Settings()
    sized = nodes.join(r0.select("map_id", "r0"), "map_id")
    clean = written(course.erased(mask, sized, F.col("r0")).select("map_id", "y", "x"))
    pairs = course.node_pairs(nodes).join(r0.select("map_id", "r0"), "map_id")
    support = written(rings.line_support(pairs, clean, F.col("r0")))
    by_lines = course.ordered_by_lines(nodes, support, cfg.leg_support_min_ratio)
    by_labels = course.ordered_by_labels(nodes, labels, support).withColumnRenamed("order", "told")
    read = labels.groupBy("map_id").agg(F.count(F.lit(1)).alias("__read"))
    both = written(by_lines.join(by_labels, "map_id", "left").join(read, "map_id", "left"))
    strong = both.join(strength(both.select("map_id", "order"), support, "__l"), "map_id", "left").join(strength(both.select("map_id", F.col("told").alias("order")), support, "__n"), "map_id", "left")
    lines_win = F.col("complete") & (F.coalesce("__l", F.lit(0.0)) > F.coalesce("__n", F.lit(0.0)))
    told, agree = F.col("told").isNotNull(), F.col("told").eqNullSafe(F.col("order"))
    notes = F.array_compact(F.array(
        F.when(told & F.col("complete") & ~agree, F.when(lines_win, "lines_taken").otherwise("numbers_taken")),
        F.when(told & ~lines_win & ~(F.col("complete") & agree) & (F.size("inferred") > 0), "numbers_inferred"),
        F.when(~told & ~F.col("complete") & F.col("__read").isNotNull(), "numbers_unclear"),
        F.when(~told & ~F.col("complete"), "incomplete"),
    ))
    return strong.select("map_id", F.when(~told | lines_win, F.col("order")).otherwise(F.col("told")).alias("order"), notes.alias("notes"))


def course_order(nodes: DataFrame, mask: DataFrame, labels: DataFrame, r0: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """Controls in course order ``(map_id, id, order, kind, x, y, r)``, one row a visit, as ``course_choice`` tells it."""
    return course.visits(nodes, course_choice(nodes, mask, labels, r0, cfg))


class Detection(NamedTuple):
    """``r0``: ``(map_id, r0)`` of maps whose size is known or was found; ``nodes``: ``(map_id, node, kind, x, y, r)``.

    ``controls``: nodes in course order, one row a visit, with the control ``code`` printed
    at them; ``px_per_mm``: ``(map_id, px_per_mm, source)`` of every map, the source being
    ``user``, ``auto`` or ``default``; ``messages``: ``(map_id, name, text)``.
    """

    r0: DataFrame
    nodes: DataFrame
    controls: DataFrame
    px_per_mm: DataFrame
    messages: DataFrame


def detection(labels: DataFrame, texts: DataFrame | None = None, cfg: Settings | None = None, starts: DataFrame | None = None, known: DataFrame | None = None) -> Detection:
    """The course of every map from its classes ``(map_id, y, x, label)``: circles, finish, start and order, at whatever scale it was scanned.

    The radius of a control follows from the circles that agree on one; the search is
    then repeated near it. ``texts`` are label boxes ``(map_id, lid, x0, y0, x1, y1,
    text)`` as some reader gave them; ``starts`` (``map_id, cx, cy, r``) are searched for
    where they are not given; ``known`` (``map_id, r0``) are radii that a user has marked,
    which go before what is found. Maps of no known size have no nodes, the default
    resolution and a message.
    """
    cfg = cfg or Settings()
    size = written(labels.groupBy("map_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")))
    raw = written(labels.where(F.col("label") == PURPLE).select("map_id", "y", "x"))
    mask = written(stencil.closed(labels.withColumn("__p", F.col("label") == PURPLE), "__p", 1, "__m").where("__m").select("map_id", "y", "x"))

    def search(low: Column, high: Column, scale: DataFrame) -> DataFrame:
        """Candidates of radii from ``low`` to ``high``, columns of ``scale``."""
        of = scale.select("map_id", F.sequence(low.cast("int"), high.cast("int")).alias("radii"))
        return rings.proposals(mask.join(of, "map_id"), F.col("radii"))

    least = F.lit(cfg.search_min_radius_px)
    most = F.greatest(least + 1, F.floor(F.least("height", "width") * cfg.search_max_radius_ratio))
    wide = written(rings.suppressed(written(rings.verified(search(least, most, size), mask, size, cfg))))
    found_r0 = rings.radius_consensus(wide, least=cfg.min_circles_for_r0).select("map_id", F.col("r0").alias("__found"))
    marked = found_r0.select("map_id", F.lit(None).cast("double").alias("__known")).limit(0) if known is None else known.select("map_id", F.col("r0").cast("double").alias("__known"))
    scales = written(size.select("map_id").join(found_r0, "map_id", "left").join(marked, "map_id", "left").select("map_id", F.coalesce("__known", "__found").alias("r0"), F.when(F.col("__known").isNotNull(), "user").when(F.col("__found").isNotNull(), "auto").otherwise("default").alias("source")))
    r0 = written(scales.where("r0 is not null").select("map_id", "r0"))

    low, high = F.greatest(F.lit(1), F.floor((1 - cfg.refine_radius_ratio) * F.col("r0"))), F.ceil((1 + cfg.refine_radius_ratio) * F.col("r0"))
    near = wide.join(r0, "map_id").where(F.col("cr").between(low, high)).select("map_id", "cid", "cx", "cy", "cr")
    found = written(rings.verified(search(low, high, r0).unionByName(near), mask, size, cfg).join(r0, "map_id"))
    circles = rings.suppressed(found, F.col("r0")).where(F.col("cr").between(low - 1, high + 1))
    circles = written(rings.relative(circles.select("map_id", "cid", "cx", "cy", "cr", "support"), cfg.relative_support_min_ratio))

    every = search(F.greatest(F.lit(1), F.floor(0.6 * F.col("r0"))), F.floor(1.5 * F.col("r0")) + 1, r0)
    sources = [c.select("map_id", "cx", "cy", "cr", F.lit(i).alias("source")) for i, c in enumerate((circles, wide, every))]
    rank = F.row_number().over(Window.partitionBy("map_id").orderBy("source", "cy", "cx", "cr"))
    centres = sources[0].unionByName(sources[1]).unionByName(sources[2]).withColumn("rank", rank)
    # The gap between the finish's rings is narrow, so the mask as it was is asked.
    finish = written(rings.finishes(centres, raw, size, r0, cfg))
    keep = rings.away_from(circles.join(r0, "map_id"), finish.select("map_id", F.col("cx").alias("ox"), F.col("cy").alias("oy")), 0.5 * F.col("r0")).drop("r0")
    if starts is None:
        # A circle at the rim of the window may be one that fits into the triangle; such circles go below.
        sure = keep.join(r0, "map_id").where(F.col("cr").between(low, high)).drop("r0")
        starts = written(triangles.starts(mask, size, r0, sure, cfg))
    columns = ["map_id", "kind", "x", "y", "r"]
    parts = [c.select("map_id", F.lit(kind).alias("kind"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cr").alias("r")) for kind, c in (("control", keep), ("finish", finish))]
    o = starts.select(F.col("map_id").alias("om"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("r").alias("o_r"))
    inside = (F.col("map_id") == F.col("om")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= F.col("o_r") + 0.5 * F.col("r"))
    parts = [parts[0].join(o, inside, "left_anti"), parts[1], starts.join(r0, "map_id", "left_semi").select("map_id", F.lit("start").alias("kind"), F.col("cx").alias("x"), F.col("cy").alias("y"), "r")]
    nodes = parts[0].select(columns)
    for more in parts[1:]:
        nodes = nodes.unionByName(more.select(columns))
    turn = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "control", 1).otherwise(2)
    nodes = written(nodes.withColumn("node", F.row_number().over(Window.partitionBy("map_id").orderBy(turn, "y", "x")) - 1))
    if texts is None:
        told = nodes.select("map_id", "node", F.array(F.lit(1)).alias("orders"), F.lit(None).cast("int").alias("code")).limit(0)
    else:
        numbers, code = course.parsed_label(F.col("text"))
        boxes = texts.withColumns({"orders": numbers, "code": code}).where("orders is not null").join(r0, "map_id")
        there = nodes.where("kind = 'control'").select("map_id", "node", F.col("x").alias("cx"), F.col("y").alias("cy"))
        pairs = course.matched(written(course.label_candidates(boxes.drop("r0"), there.join(r0, "map_id"), F.col("r0"), cfg.label_max_distance_ratio)))
        told = pairs.join(boxes.select("map_id", "lid", "orders", "code"), ["map_id", "lid"]).select("map_id", "node", "orders", "code")
    told = written(told)
    choice = written(course_choice(nodes, mask, told.select("map_id", "node", "orders"), r0, cfg))
    codes = told.where("code is not null").select("map_id", "node", "code")
    controls = written(course.visits(nodes.join(codes, ["map_id", "node"], "left"), choice, ["code"]))
    kinds = nodes.groupBy("map_id").agg(F.collect_set("kind").alias("kinds"))
    state = scales.join(kinds, "map_id", "left").join(choice.select("map_id", "notes"), "map_id", "left")
    known_size = F.col("r0").isNotNull()
    lacks = [F.when(known_size & ~F.coalesce(F.array_contains("kinds", kind), F.lit(False)), f"no_{kind}") for kind in ("start", "finish")]
    names = F.concat(F.array_compact(F.array(F.when(~known_size, "no_scale"), *lacks)), F.coalesce("notes", F.array().cast("array<string>")))
    text = F.element_at(F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair]), F.col("name"))
    messages = written(state.select("map_id", F.explode(names).alias("name")).withColumn("text", text))
    ppm = F.coalesce(2 * F.col("r0") / cfg.control_diameter_mm, F.lit(cfg.default_px_per_mm))
    return Detection(r0, nodes, controls, scales.select("map_id", ppm.alias("px_per_mm"), "source"), messages)


def label_boxes(found: Detection, labels: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """``(map_id, lid, x0, y0, x1, y1, n)``: boxes of lines of text on detected maps, ends exclusive, for a reader of labels.

    ``labels`` is ``(map_id, y, x, label)``, with a ``purple_score`` if there is one, which
    holds digits together where the classes break them apart. Symbols and legs are erased,
    the rest is grouped to lines of ``n`` components. What a reader makes of the boxes are
    the ``texts`` of ``detection``; ``lid`` is made of a line's place.
    """
    cfg = cfg or Settings()
    ink = F.col("label") == PURPLE
    if "purple_score" in labels.columns:
        ink = ink | (F.col("purple_score") >= cfg.label_score_min_ratio)
    mask = written(labels.where(ink).join(found.r0, "map_id", "left_semi").select("map_id", "y", "x"))
    sized = found.nodes.join(found.r0, "map_id")
    clean = course.erased(mask, sized, F.col("r0")).select("map_id", "y", "x")
    pairs = course.node_pairs(found.nodes).join(found.r0, "map_id")
    legs = rings.line_support(pairs, clean, F.col("r0")).where(F.col("support") >= course.LEG_SUPPORT)
    text = written(course.text_ink(mask, sized, pairs.join(legs, ["map_id", "i", "j"], "left_semi"), F.col("r0")).select("map_id", "y", "x"))
    parts = graph.component_stats(graph.mask_components(text)).join(found.r0, "map_id")
    place = F.col("comp.y").cast("long") * (1 << 32) + F.col("comp.x")
    parts = written(parts.select("map_id", place.alias("part"), "area", "x0", "y0", (F.col("x1") + 1).alias("x1"), (F.col("y1") + 1).alias("y1"), "r0"))
    return course.text_lines(parts, F.col("r0")).withColumnRenamed("line", "lid")


#: Resolutions are told apart by this much, in pixels a millimetre: less than 1 % of any scan's that can be read.
SCALE_STEP = 0.05


def at_own_scale(px_per_mm: DataFrame, run: Callable[[DataFrame, float], DataFrame], step: float = SCALE_STEP) -> DataFrame:
    """What ``run(maps, px_per_mm)`` gives for all maps, each at its own resolution, as ``detection`` tells them.

    ``px_per_mm`` is ``(map_id, px_per_mm)``. Widths of windows are part of a plan, so
    there is one run for each resolution that occurs, to the nearest ``step``: a few
    hundred at most, however many maps there are. ``maps`` are the ``map_id`` of a run,
    to be semi-joined with what it reads. Maps without a resolution, or one that is not
    above zero, have no rows; without any map the result is that of ``run`` on none.
    """
    own = written(px_per_mm.where("px_per_mm > 0").select("map_id", F.greatest(F.lit(1), F.rint(F.col("px_per_mm") / step)).cast("int").alias("__step")).distinct())
    scales = sorted(r[0] for r in own.select("__step").distinct().collect())
    runs = [run(own.where(F.col("__step") == k).select("map_id"), k * step) for k in scales] or [run(own.select("map_id"), 1.0)]
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out


def layers(planes: DataFrame, cells: DataFrame, cell_px: int, size: DataFrame) -> DataFrame:
    """``(name, y, x, r, g, b, alpha)`` of all rendered layers, named ``<map>-<layer>``."""

    def shown(kind: str, df: DataFrame, colors: dict[str, Column]) -> DataFrame:
        return df.select(F.concat_ws("-", F.col("map_id").cast("string"), F.lit(kind)).alias("name"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[c.cast("int").alias(n) for n, c in colors.items()])

    out = shown("labels", planes, classify.palette(F.col("label")))
    for kind, (column, rgba) in MASK_LAYERS.items():
        out = out.unionByName(shown(kind, planes.where(F.col(column)), classify.mask_rgba(F.col(column), rgba)))
    ramp = classify.enlarged(classify.cost_ramp(cells.withColumnRenamed("r", "row")).withColumnsRenamed({"r": "red", "row": "r"}), cell_px, size)
    return out.unionByName(shown("cost", ramp, {"r": F.col("red"), "g": F.col("g"), "b": F.col("b"), "alpha": F.col("alpha")}))


def analysed(pixels: DataFrame, folder: str, px_per_mm: float, samples: DataFrame | None = None, edits: DataFrame | None = None, cfg: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Analyse maps from pixels to stored layers: returns planes and cost cells, and writes every layer as a PNG file to ``folder``."""
    cfg = cfg or Settings()
    labels = written(segmented(pixels, cfg, samples))
    planes = terrain_planes(labels, px_per_mm, cfg, labels)
    cells = cost_grid(planes, px_per_mm, edits, cfg)
    size = planes.groupBy("map_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    drawn = layers(planes, cells, terrain.cell_size(px_per_mm, cfg), size)
    kinds = F.explode(F.array(*map(F.lit, LAYERS)))
    canvas = size.select("map_id", "height", "width", kinds.alias("kind")).select(F.concat_ws("-", F.col("map_id").cast("string"), "kind").alias("name"), "height", "width")
    images.write_pngs(images.png_files(drawn, canvas), folder)
    return planes, cells


def routes(controls: DataFrame, cells: DataFrame, cell_px: int, px_per_mm: float, scale: int = 4000, cfg: Settings | None = None) -> DataFrame:
    """Least-cost legs between consecutive controls, each snapped to the nearest ground that is no small pocket."""
    cfg = cfg or Settings()
    least = int(cfg.snap_min_component_mm2 * (px_per_mm / cell_px) ** 2)
    free = cells.where(F.col("cost") < float("inf")).select("map_id", F.col("r").alias("y"), F.col("c").alias("x"))
    comps = written(graph.mask_components(free))
    sizes = graph.component_stats(comps).select("map_id", "comp", "area")
    most = sizes.groupBy("map_id").agg(F.max("area").alias("most"))
    large = sizes.join(most, "map_id").where(F.col("area") >= F.least(F.lit(least), F.col("most"))).select("map_id", "comp")
    ground = written(comps.join(large, ["map_id", "comp"], "left_semi").select("map_id", F.col("y").alias("r"), F.col("x").alias("c")))
    points = controls.select("map_id", F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    snapped = written(nearest.snap(points, cells, ground, cell_px).select("map_id", "pid", "r", "c"))
    return routing.legs(controls, cells, snapped, cell_px, scale, px_per_mm)
