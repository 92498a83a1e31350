"""Near-duplicate documents by an exact set-similarity join of their word shingles.

Documents are sets of distinct shingles, so a line that repeats counts once. Equal sets
form a class; classes link where their Jaccard similarity is at least the one asked for,
and groups are components of links. The join is that of ``line_dedup`` with shingles in
place of words: prefixes of the rarest shingles bring similar sets together in runs, and
length, position and parity maps discard pairs exactly.

A pair must be verified in the run of the first prefix shingle that it shares, and sets
are large, so they are to go to few runs. A row carries hashes of shingles ahead of the
run's own: first that just ahead, then the least under ``N_KNOWN`` hash functions of
those under which it stayed. Two rows with an equal hash share an earlier shingle, so
their pair is left to an earlier run; in the run of its first shared shingle a pair never
is. Sets go to the runs in which a row still stays, and are verified there, breadth first:
groups need no counts, so a row leaves a run as soon as it is linked. Nothing is ever
gathered by candidate components, however long a chain of look-alikes is. Shingles are
hashed to 64 bits.

What is known to be near already, as by fingerprints, is verified first; pairs within one
group of what that links are connected, so the join leaves them out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartospark.llm.common import as_bytes, connected_components, slices, written
from kartospark.llm.line_dedup import _SLICE, BLOCK, ROUNDS, _cell, _classes, _dealt, _hot, _may_match, _mixed, _pairs, _Powers, _prefix, _same, _sorted_runs, _whole_runs, _words, rarity
from kartospark.sources.shared import discard, forget

#: Shingles to a word of a parity map; a document has one map for each prefix shingle, so maps are kept short.
PER_WORD = 128
#: Longest run compared pair by pair at once; longer ones breadth first.
LONG_RUN = 256
#: Sets of one run compared inside one task.
SETS_BLOCK = 1024
#: Hashes by which a pair is known to share a shingle of an earlier run.
N_KNOWN = 8
_MARKED = "doc_id long, text_key long, class long, size int, parity binary, single int, words array<long>, hot array<long>"


def _shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles of ``size`` words (A-Z in lower case), and the text each is of; fewer words make one shingle, none make none."""
    token, line, first = _words(texts)
    count = np.bincount(np.searchsorted(first, line, side="right") - 1, minlength=len(texts))
    n = np.maximum(count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(row)) + np.repeat(np.cumsum(count) - count - np.cumsum(n) + n, n)
    length = np.minimum(count, size)[row]
    h = length.astype(np.uint64)
    for k, factor in enumerate(_Powers.upto(size)[0]):
        on = np.flatnonzero(length > k)
        h[on] += token[at[on] + k] * factor
    return _mixed(h), row


def _hashes(texts: list[bytes | None], size: int) -> np.ndarray:
    return _shingles(texts, size)[0]


def _sets(texts: list[bytes | None], size: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text by rarity, then hash: where a text's begin (closed by the total), the hashes and their levels."""
    token, row = _shingles(texts, size)
    lv = level[_cell(token)]
    bits = np.uint64(max(1, len(texts).bit_length()))
    # One number to sort by: text, level, leading bits of the hash.
    key = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (lv.astype(np.uint64) << (np.uint64(56) - bits)) | (token >> (np.uint64(8) + bits))
    order = np.argsort(key)
    token, lv, row = token[order], lv[order], row[order]
    once = np.ones(len(token), dtype=bool)
    once[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, lv, row = token[once], lv[once], row[once]
    return np.searchsorted(row, np.arange(len(texts) + 1)), token, lv


def _described(start: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Class and parity map of each text's set; texts without words are class 0 with an empty map."""
    full = np.flatnonzero(np.diff(start))
    cls, flat, offset = _classes(np.append(start[full], len(token)), token, PER_WORD)
    out = np.zeros(len(start) - 1, dtype=np.uint64)
    out[full] = cls
    ends = np.zeros(len(start), dtype=np.int64)
    ends[full + 1] = 8 * np.diff(offset)
    return out, pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(np.cumsum(ends).astype(np.int32)), pa.py_buffer(flat)])


def _mark_batches(batches: Iterator[pa.RecordBatch], level, shingle: int, similarity: float, block: int) -> Iterator[pa.RecordBatch]:
    """Each text's class, size, parity map and the prefix shingles that may occur elsewhere.

    Shingles that occur once are the first of a prefix and left out; a class's shingles are
    listed once a task. ``hot`` are those that occur often enough for a long run.
    """
    level, seen = level.value, set()
    many = 1 + int(np.log2(block) * 5)
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            start, token, lv = _sets(as_bytes(part.column("text")), shingle, level)
            cls, parity = _described(start, token)
            size = np.diff(start)
            fresh = np.zeros(len(cls), dtype=bool)
            for i in np.unique(cls, return_index=True)[1].tolist():
                c = int(cls[i])
                if c not in seen:
                    seen.add(c)
                    fresh[i] = True
            row = np.repeat(np.arange(len(cls)), size)
            single = np.bincount(row[lv == 0], minlength=len(cls))
            listed = fresh[row] & (np.arange(len(token)) - start[row] < _prefix(size, similarity)[row]) & (lv > 0)

            def lists(which: np.ndarray, row: np.ndarray = row, token: np.ndarray = token, n: int = len(cls)) -> pa.ListArray:
                at = np.flatnonzero(which)
                return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32)), pa.array(token[at].view(np.int64)))

            columns = [pa.array(cls.view(np.int64)), pa.array(size.astype(np.int32)), parity, pa.array(single.astype(np.int32)), lists(listed), lists(listed & (lv >= many))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *columns], names=["doc_id", "text_key", "class", "size", "parity", "single", "words", "hot"])


def _reached(start: int, stop: int, matches: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Links of a run, breadth first: each row leaves the search when first reached."""
    left = np.arange(start, stop)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            row = queue.pop()
            hit = matches(row, left)
            if hit.any():
                yield row, left[hit]
                queue += left[hit].tolist()
                left = left[~hit]


def _stay_batches(batches: Iterator[pa.RecordBatch], similarity: float, known: tuple[str, ...], kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of each run that are in a pair of two groups which the filters leave and which no ``known`` shows to share a shingle of an earlier run.

    ``known`` are hashes of shingles ahead of the run's, 0 for none; two sets with an equal one both have that shingle.
    """
    for rows in _whole_runs(batches):
        r, starts, order = _sorted_runs(rows, ["class", "packed", "group", *known])
        told = [(r[n], r[n] != 0) for n in known]

        def first(i: np.ndarray, j: np.ndarray, told: list = told, group: np.ndarray = r["group"]) -> np.ndarray:
            ok = group[i] != group[j]
            for h, there in told:
                ok &= (h[i] != h[j]) | ~there[i]
            return ok

        stays = np.zeros(len(order), dtype=bool)
        for i, j in _pairs(r, starts, similarity, LONG_RUN):
            ok = first(i, j)
            stays[i[ok]] = stays[j[ok]] = True
        for k in np.flatnonzero(np.diff(starts) > LONG_RUN).tolist():

            def matches(row: int, left: np.ndarray, r: dict = r, first: Callable = first) -> np.ndarray:
                one = np.full(len(left), row)
                ok = first(one, left)
                ok[ok] = _may_match(r, one[ok], left[ok], similarity)
                return ok

            for row, hit in _reached(starts[k], starts[k + 1], matches):
                stays[row] = stays[hit] = True
        yield pa.RecordBatch.from_arrays([rows.column(n).combine_chunks().take(pa.array(order[stays])) for n in kept], names=list(kept))


def _set_batches(batches: Iterator[pa.RecordBatch], level, shingle: int) -> Iterator[pa.RecordBatch]:
    """Sets of the texts, with what is known of them."""
    level = level.value
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            start, token, _ = _sets(as_bytes(part.column("text")), shingle, level)
            cls, parity = _described(start, token)
            sets = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(token.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), parity, sets], names=["c", "parity", "words"])


def _verify_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links that connect the classes of each run as its similar pairs do."""
    for rows in _whole_runs(batches):
        r, starts, order = _sorted_runs(rows, ["class", "packed"])
        words = rows.column("words").combine_chunks()
        flat, offsets = words.values.to_numpy(), words.offsets.to_numpy()
        sets = [flat[offsets[k] : offsets[k + 1]] for k in order.tolist()]

        def matches(row: int, left: np.ndarray, r: dict = r, sets: list = sets) -> np.ndarray:
            ok = _may_match(r, np.full(len(left), row), left, similarity)
            mine = np.sort(sets[row])
            at = np.flatnonzero(ok)
            for some in np.array_split(at, 1 + len(at) // 1000) if len(at) else ():
                token = np.concatenate([sets[k] for k in left[some].tolist()])
                size = r["size"][left[some]]
                there = mine[np.minimum(np.searchsorted(mine, token), len(mine) - 1)] == token
                common = np.add.reduceat(there.astype(np.int64), np.cumsum(size) - size)
                ok[some] = common >= similarity * (len(mine) + size - common) - 1e-9
            return ok

        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for k in np.flatnonzero(np.diff(starts) > 1).tolist():
            for row, hit in _reached(starts[k], starts[k + 1], matches):
                a.append(np.full(len(hit), row))
                b.append(hit)
        yield pa.RecordBatch.from_arrays([pa.array(r["class"][np.concatenate(a)]), pa.array(r["class"][np.concatenate(b)])], names=["a", "b"])


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", near: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_key, root)`` for every row; ``root`` names the group.

    Texts link where the Jaccard similarity of their sets of distinct shingles is at least
    ``similarity``; groups are components of links. All such links count and no others.
    Texts of fewer words than a shingle are one shingle, texts without words one group.
    ``near`` is ``(key, text_key)``: texts under one key may be alike. They are verified
    first; the result does not depend on them.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    level = docs.sparkSession.sparkContext.broadcast(rarity(rows, partial(_hashes, size=shingle)))
    marked = written(rows.mapInArrow(partial(_mark_batches, level=level, shingle=shingle, similarity=similarity, block=block), _MARKED))

    def verified(met: DataFrame) -> DataFrame:
        one = marked.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).join(met.select("class").distinct(), "class", "left_semi")
        wanted = one.select(F.col("one.doc_id").alias("w_id"), F.col("one.text_key").alias("w_key"))
        texts = rows.join(wanted, _same("doc_id", "w_id") & (F.col("text_key") == F.col("w_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
        sets = texts.select("text").mapInArrow(partial(_set_batches, level=level, shingle=shingle), "c long, parity binary, words array<long>")
        hot = _hot(met, min(block, SETS_BLOCK))
        return written(_dealt(met.join(sets, F.col("class") == F.col("c")).drop("c"), hot).mapInArrow(partial(_verify_batches, similarity=similarity), "a long, b long").distinct())

    grouped, links = marked.withColumn("group", F.col("class")), []
    if near is not None:
        told = near.join(marked.where("size > 0").select("text_key", "class", F.shiftleft(F.col("size").cast("long"), 32).alias("packed")).distinct(), "text_key").select("key", "class", "packed").distinct()
        told = written(told)
        told = written(told.join(told.groupBy("key").count().where("count > 1"), "key", "left_semi"))
        links.append(verified(told))
        ahead = written(connected_components(links[0]))
        grouped = marked.join(ahead, F.col("class") == F.col("v"), "left").withColumn("group", F.coalesce("root", "class")).drop("v", "root")
        del told, ahead
        forget(docs.sparkSession)

    # Runs, first by what a row can tell alone: one that shares the shingle ahead of the run's was met there.
    listed = grouped.where(F.size("words") > 0)
    hot = _hot(listed.select(F.explode("hot").alias("key")), block)
    packed = F.shiftleft(F.col("size").cast("long"), 32) + F.shiftleft(F.col("single"), 2)
    each = listed.select("class", "group", "parity", packed.alias("packed"), "words", F.posexplode("words").alias("place", "key"))
    postings = each.select("key", "class", "group", "parity", (F.col("packed") + F.shiftleft("place", 2)).alias("packed"), F.col("key").alias("word"), F.coalesce(F.get("words", F.col("place") - 1), F.lit(0)).alias("before"))
    columns = "key long, class long, packed long, group long, word long, parity binary"
    stay = partial(_stay_batches, similarity=similarity, known=("before",), kept=("key", "class", "packed", "group", "word", "parity"))
    parts = [written(_dealt(postings.where(F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == i), hot).mapInArrow(stay, columns)) for i in range(ROUNDS)]
    found = reduce(DataFrame.unionByName, parts)
    del grouped, listed, hot, each, postings
    forget(docs.sparkSession)

    # Again, by least hashes of the shingles ahead under which a row has stayed: what is left of a pair is its first run and few more.
    ahead = Window.partitionBy("class").orderBy(F.expr("(packed >> 2) & 1073741823")).rangeBetween(Window.unboundedPreceding, -1)
    known = {f"known{k}": F.coalesce(F.min(F.xxhash64("word", F.lit(k))).over(ahead), F.lit(0)) for k in range(N_KNOWN)}
    told = found.withColumns(known).drop("word").repartition("key").sortWithinPartitions("key")
    met = written(told.mapInArrow(partial(_stay_batches, similarity=similarity, known=tuple(known), kept=("key", "class", "packed")), "key long, class long, packed long").withColumn("packed", F.expr("packed & ~3L")))
    discard(*parts)
    del found, told, parts
    forget(docs.sparkSession)

    links.append(verified(met))
    discard(met)
    del met
    forget(docs.sparkSession)
    roots = written(connected_components(reduce(DataFrame.unionByName, links)))
    named = marked.select("doc_id", "text_key", "class").join(roots, F.col("class") == F.col("v"), "left")
    return named.select("doc_id", "text_key", F.coalesce("root", "class").alias("root"))
