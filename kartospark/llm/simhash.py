"""SimHash near-duplicate detection with pivot distance tables.

A text's fingerprint has a bit set where more than half of its shingles' 64-bit
hashes have it. Texts link when their fingerprints differ in at most ``distance``
bits; components of links are groups of near duplicates.

Finding links without comparing all pairs:

1. Equal fingerprints collapse to one row (map-side combined), so exact copies, however
   many, cost one row.
2. The 64 bits are cut into ``distance + 2`` bands. ``distance`` flipped bits leave at
   least two bands untouched, so every linked pair shares one of the band pairs: an
   equality key that shuffles by hash. This loses no link.
3. Inside a key, fingerprints carry a pivot distance table: their Hamming distances to
   ``N_PIVOTS`` fixed reference fingerprints. By the triangle inequality two fingerprints
   cannot be closer than their largest difference in any coordinate; pairs beyond the
   limit are discarded on these bytes alone, survivors are verified bit by bit.
4. A key's linked rows are reported as a spanning forest, never as all pairs, and a key
   with more than ``block`` rows is cut into pairs of blocks over many tasks.
5. Components come from a distributed star contraction over the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartospark.llm.common import as_bytes, checkpointed, connected_components, run_starts, slices, unused, written
from kartospark.llm.shingle_sets import similar_groups

SEED = 42
N_PIVOTS = 16
#: Rows of one band key compared inside one task; a larger key is cut into pairs of blocks.
BLOCK = 8192
#: Runs up to this length are compared pair by pair, longer ones breadth first.
SHORT_RUN = 16

_LOW = np.uint64(0x0101010101010101)
_PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}", 1) for i in range(N_PIVOTS)], dtype=np.uint64)


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 of each ``size``-word shingle of the lower-cased (A-Z) text; fewer words make one shingle, none make none."""
    words = text.lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive texts that own ``counts`` hashes each.

    Eight bit planes are summed as packed byte counters over stretches of at most 255
    hashes, then widened and added up by text.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    counts = counts[full]
    pieces = -(-counts // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    piece_start = (np.cumsum(counts) - counts)[owner] + 255 * nth
    text_start = np.cumsum(pieces) - pieces
    for plane in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(plane)) & _LOW, piece_start)
        sums = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), text_start, axis=0)
        for byte in range(8):
            bit = np.uint64(8 * byte + plane)
            out[full] |= (2 * sums[:, byte] > counts).astype(np.uint64) << bit
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashed = [np.array(shingle_hashes(t, size), dtype=np.uint64) for t in as_bytes(part.column("text"))]
            counts = np.array([len(h) for h in hashed], dtype=np.int64)
            fp = majority_bits(np.concatenate(hashed), counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the 64-bit fingerprint as a signed long (0 for a text without words)."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(partial(_fingerprint_batches, size=shingle), "doc_id long, fp long")


def band_masks(distance: int) -> list[int]:
    """Masks of all pairs of the ``distance + 2`` bands that the 64 bits are cut into."""
    n = distance + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    bands = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(bands, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    return np.bitwise_count(fps[:, None] ^ _PIVOTS[None, :]).astype(np.int8)


def _survivors(near: np.ndarray, one: np.ndarray, distance: int) -> np.ndarray:
    """Rows of the pivot table ``near`` that no coordinate rules out against the row ``one``."""
    alive = np.flatnonzero(np.abs(near[:, 0] - one[0]) <= distance)
    for k in range(1, N_PIVOTS):
        if not len(alive):
            break
        alive = alive[np.abs(near[alive, k] - one[k]) <= distance]
    return alive


def _forest(fps: np.ndarray, table: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning forest of the link graph of one key, breadth first: each row leaves the search when first reached."""
    left, near, a, b = fps, table, [], []
    while len(left) > 1:
        queue = [(left[0], near[0])]
        left, near = left[1:], near[1:]
        while queue and len(left):
            fp, row = queue.pop()
            hit = _survivors(near, row, distance)
            hit = hit[np.bitwise_count(left[hit] ^ fp) <= distance]
            if len(hit):
                a.append(np.full(len(hit), fp))
                b.append(left[hit])
                queue += zip(left[hit], near[hit], strict=True)
                keep = np.ones(len(left), dtype=bool)
                keep[hit] = False
                left, near = left[keep], near[keep]
    return a, b


def _links_of(fps: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of one key each."""
    table = pivot_table(fps)
    length = np.diff(starts)
    run_end = np.repeat(starts[1:], length)
    short = np.repeat(length <= SHORT_RUN, length)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    rows = np.flatnonzero(short)
    for shift in range(1, SHORT_RUN):
        rows = rows[rows + shift < run_end[rows]]
        if not len(rows):
            break
        alive = rows
        for k in range(N_PIVOTS):
            alive = alive[np.abs(table[alive, k] - table[alive + shift, k]) <= distance]
        alive = alive[np.bitwise_count(fps[alive] ^ fps[alive + shift]) <= distance]
        a.append(fps[alive])
        b.append(fps[alive + shift])
    for i in np.flatnonzero(length > SHORT_RUN):
        more = _forest(fps[starts[i] : starts[i + 1]], table[starts[i] : starts[i + 1]], distance)
        a += more[0]
        b += more[1]
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _link_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last run of a batch may go on in the next one."""
    names = ("t", "k", "p", "fp")
    held = {n: np.empty(0, dtype=np.int64) for n in names}

    def out(upto: int) -> pa.RecordBatch:
        cut = {n: v[:upto] for n, v in held.items()}
        starts = run_starts(cut["t"], cut["k"], cut["p"])
        a, b = _links_of(cut["fp"].view(np.uint64), starts, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = {n: np.concatenate([held[n], batch.column(n).to_numpy().astype(np.int64)]) for n in names}
        upto = run_starts(held["t"], held["k"], held["p"])[-2]
        if upto:
            yield out(upto)
            held = {n: v[upto:] for n, v in held.items()}
    if len(held["fp"]):
        yield out(len(held["fp"]))


def links(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that differ in at most ``distance`` bits.

    Links of one key form a spanning forest of its link graph, so the components are
    exactly those of all linked pairs.
    """
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in band_masks(distance)])
    rows = fps.select("fp", F.posexplode(keys).alias("t", "k"))
    hot = rows.groupBy("t", "k").count().where(F.col("count") > block).selectExpr("t", "k", f"cast(ceil(count / {block}) as int) n")
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    other = F.sequence(F.lit(0), F.col("n") - 1)
    pairs = F.transform(other, lambda o: F.least(o, mine) * F.col("n") + F.greatest(o, mine))
    dealt = rows.join(hot, ["t", "k"], "left").select("t", "k", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("p"))
    ordered = dealt.repartition("t", "k", "p").sortWithinPartitions("t", "k", "p")
    return ordered.mapInArrow(partial(_link_batches, distance=distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own included.
    Null and blank texts have fingerprint zero and link like any other; texts of fewer
    words than a shingle are one shingle. Repeated rows are kept, each with the same
    component. Null ids take part but never name a component (one of null ids alone has
    a null ``component_id``). An empty table gives an empty result. Other columns are
    not read.
    """
    marked = written(fingerprints(docs, shingle, id_col, text_col))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = checkpointed(connected_components(links(fps, distance, block)))
    linked = fps.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "rep", "root")
    lowest = linked.where("root is not null").groupBy("root").agg(F.min("rep").alias("low"))
    named = linked.join(lowest, "root", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def near_runs(docs: DataFrame, shingle: int = 5, distance: int = 4, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """``(key, text_key)``: texts of fingerprints that pivot tables link to one (``key``), it included; ``text_key`` is the text's hash."""
    text = F.col(text_col).cast("string")
    marked = written(fingerprints(docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")), shingle, "text_key", "text").distinct())
    found = links(marked.select("fp").distinct(), distance, block).select(F.col("a").alias("key"), F.col("b").alias("fp"))
    own = marked.select(F.col("fp").alias("key"), "fp")
    return found.union(own).distinct().join(marked, "fp").select("key", F.col("doc_id").alias("text_key"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """The rows of ``docs`` but for all except one of each near-duplicate group, with the columns of ``docs``.

    Texts whose fingerprints differ in at most ``distance`` bits meet by pivot tables, and
    an exact check of their sets of shingles follows. Pairs of the similarity whose
    fingerprints are farther apart come from the set join (``shingle_sets``), which leaves
    out what the tables have connected.

    The row with the smallest id stays (a null id comes last; of texts that share it the
    one with the smallest hash, of repeated rows any). Texts without words are one group.
    """
    near = near_runs(docs, shingle, distance, text_col=text_col)
    groups = similar_groups(docs, shingle, similarity, id_col=id_col, text_col=text_col, near=near)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    i, k, mine = unused(docs, "id", "key", "mine")
    stays = groups.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.doc_id").alias(i), F.col("first.text_key").alias(k))
    keyed = docs.withColumn(mine, F.xxhash64(F.col(text_col).cast("string")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.col(mine) == F.col(k))
    return keyed.join(stays, same, "left_semi").dropDuplicates([id_col, mine]).drop(mine)
