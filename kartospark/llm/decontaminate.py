"""Benchmark decontamination over a distributed positional inverted index.

Test items are cut into windows of ``WINDOW`` consecutive words. Words of the test set
are counted over all documents, which ranks a window's terms by rarity.

The index is a table with one row per shard (about a megabyte of training text): the
shard's documents and, term by term, the positions of its tokens. A window that occurs,
or nearly does, has one of its rarest terms there (its anchors: so many that they cannot
all be missing), so postings are kept for test terms near anchors only. A search starts
from the anchors' positions, shifts them by the term's offset and intersects with the
shifted lists of the next rarest terms, for all windows of a shard together; its work
follows the anchors' occurrences, not the number of windows.

An exact match is an occurrence of the window. A proximity match is a stretch of a
document, ``SLOP`` words longer than the window, with all of the window's words but a
tenth, repeats counted, in any order.

Test items reach the tasks in blocks of about ``BLOCK_BYTES`` of text, whatever the size
of the test set; each block is run against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartospark.llm.common import as_bytes, run_starts, slices, unused, written

WINDOW = 10
#: Test text sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: A proximity match may lack this share of a window's words.
NEAR_LACK = 0.1
#: Words by which the stretch of a proximity match is longer than the window.
SLOP = 5
#: Training text of one row of the index.
SHARD_BYTES = 1 << 20
#: Pairs of a window and a position that are looked at together.
PIECE = 100_000
# Positions between two documents of a shard, so that no stretch has words of both.
_GAP = 4 * (WINDOW + SLOP)

# A-Z to lower case; every other ASCII character that is no letter or digit to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_INDEX = "doc_id array<long>, text_key array<long>, n_words array<int>, term array<int>, n_post array<int>, position array<int>"
_FOUND = "doc_id long, text_key long, n_words long, hits array<int>, items array<string>, n_near long"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class TestSet(NamedTuple):
    """Items of a block: their words end to end, and their windows as stretches of these."""

    ids: dict[bytes, int]
    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray  # number of each window's item
    names: list[str | None]

    def terms(self, windows: np.ndarray) -> np.ndarray:
        """Terms of windows, one row each; -1 beyond their length."""
        at = np.arange(WINDOW)
        inside = at < self.length[windows, None]
        return np.where(inside, self.flat[np.minimum(self.start[windows, None] + at, len(self.flat) - 1)], -1)


def test_set(rows: list[tuple[str | None, str | None]]) -> TestSet:
    ids: dict[bytes, int] = {}
    flat, start, length, item = [], [], [], []
    for i, (_, text) in enumerate(rows):
        terms = [ids.setdefault(w, len(ids)) for w in words(text.encode() if text else None)]
        n = max(1, len(terms) - WINDOW + 1) if terms else 0
        start += range(len(flat), len(flat) + n)
        length += [min(WINDOW, len(terms))] * n
        item += [i] * n
        flat += terms
    return TestSet(ids, *(np.array(x, dtype=np.int32) for x in (flat, start, length, item)), [name for name, _ in rows])


class Plan(NamedTuple):
    """Where searches start: windows by anchor term, ``window[first[t] : first[t + 1]]`` for term t, and the anchor's offset."""

    tests: TestSet
    rank: np.ndarray  # of each term, rarest first
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    rarest: np.ndarray  # whether the anchor is the window's rarest term


def search_plan(tests: TestSet, counts: np.ndarray) -> Plan:
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    anchors: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(tests.start), PIECE):
        windows = np.arange(low, min(low + PIECE, len(tests.start)))
        terms = tests.terms(windows)
        by_rank = np.where(terms >= 0, rank[terms], len(counts))
        order = np.argsort(by_rank, axis=1, kind="stable")
        ranks = np.take_along_axis(by_rank, order, axis=1)
        lack = np.floor(NEAR_LACK * tests.length[windows] + 1e-9).astype(np.int64)
        new = np.append(np.ones((len(windows), 1), dtype=bool), ranks[:, 1:] != ranks[:, :-1], axis=1)
        # Of the words in order of rarity only the first ``lack`` can be missing, so a distinct term among these and the next is there.
        row, place = np.nonzero(new & (np.arange(WINDOW) <= lack[:, None]) & (ranks < len(counts)))
        at = order[row, place]
        anchors.append((terms[row, at], windows[row], at, place == 0))
    term, window, offset, rarest = (np.concatenate(x) if anchors else np.empty(0, dtype=np.int64) for x in (zip(*anchors, strict=True) if anchors else [()] * 4))
    by_term = np.argsort(term, kind="stable")
    first = np.searchsorted(term[by_term], np.arange(len(counts) + 1))
    return Plan(tests, rank, first, window[by_term].astype(np.int32), offset[by_term].astype(np.int8), rarest[by_term].astype(bool))


def _ids(ids: dict[bytes, int], texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    split = [words(t) for t in texts]
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    return np.fromiter(map(ids.get, chain.from_iterable(split), repeat(-1)), dtype=np.int64, count=int(n_words.sum())), n_words


def _count_batches(batches: Iterator[pa.RecordBatch], tests) -> Iterator[pa.RecordBatch]:
    """Occurrences of the test terms in a task's texts."""
    tests = tests.value
    total = np.zeros(len(tests.ids), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, _ = _ids(tests.ids, as_bytes(part.column("text")))
            total += np.bincount(ids[ids >= 0], minlength=len(total))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["term", "n"])


def _around(at: np.ndarray, reach: int, total: int) -> np.ndarray:
    """Whether each position is within ``reach`` of one of ``at``."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(at - reach, 0), 1)
    np.add.at(edge, np.minimum(at + reach + 1, total), -1)
    return np.cumsum(edge[:-1]) > 0


def _index_batches(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    plan = plan.value
    anchor = np.append(np.diff(plan.first) > 0, False)
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            ids, n_words = _ids(plan.tests.ids, as_bytes(part.column("text")))
            kept = np.flatnonzero((ids >= 0) & _around(np.flatnonzero(anchor[ids]), WINDOW + SLOP, len(ids)))
            order = kept[np.argsort(ids[kept], kind="stable")]
            cuts = run_starts(ids[order])
            lists = [part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), n_words, ids[order[cuts[:-1]]], np.diff(cuts), order]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.list_(k)) for x, k in zip(lists, kinds, strict=True)], names=["doc_id", "text_key", "n_words", "term", "n_post", "position"])


def build_index(docs: DataFrame, plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, one row per shard. ``position`` counts words through all documents of the shard."""
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return picked.mapInArrow(partial(_index_batches, plan=plan), _INDEX)


class _Shard:
    """Postings of one row of the index; positions have gaps between documents."""

    def __init__(self, n_words: np.ndarray, term: np.ndarray, n_post: np.ndarray, position: np.ndarray):
        self.n_words = n_words
        ends = np.cumsum(n_words)
        doc = np.searchsorted(ends, position, side="right")
        self.base = ends - n_words + _GAP * (1 + np.arange(len(n_words)))
        self.position = position + _GAP * (1 + doc)
        self.doc = doc
        self.term = np.repeat(term, n_post).astype(np.int64)
        self.size = int(n_words.sum()) + _GAP * (len(n_words) + 2)
        self.key = self.term * self.size + self.position  # ascending

    def between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a position from ``low`` to ``high``; no term (-1) has none."""
        at = np.searchsorted(self.key, term * self.size + low)
        return (at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] <= term * self.size + high)

    def dense(self) -> np.ndarray:
        out = np.full(self.size, -1, dtype=np.int64)
        out[self.position] = self.term
        return out


def _near(dense: np.ndarray, terms: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether some stretch around each position has enough of its window's words, repeats counted."""
    reach = length + SLOP
    most = WINDOW + SLOP
    around = np.arange(1 - most, most)
    ids = dense[np.clip(at[:, None] + around, 0, len(dense) - 1)]
    ids[np.abs(around) >= reach[:, None]] = -1
    best = np.zeros(len(at), dtype=np.int64)
    rows = np.arange(len(at))[:, None]
    ends = np.minimum(np.arange(most) + reach[:, None], len(around))
    found = np.zeros((len(at), most), dtype=np.int64)
    for j in range(WINDOW):
        mine = terms[:, j]
        first = (mine >= 0) & ~(terms[:, :j] == mine[:, None]).any(axis=1)
        times = (terms == mine[:, None]).sum(axis=1)
        total = np.append(np.zeros((len(at), 1), dtype=np.int64), np.cumsum(ids == mine[:, None], axis=1), axis=1)
        some = np.minimum(total[rows, ends] - total[:, :most], times[:, None])
        found += np.where(first[:, None], some, 0)
    best = found.max(axis=1)
    return best >= length - np.floor(NEAR_LACK * length + 1e-9)


def _search(plan: Plan, shard: _Shard) -> tuple[np.ndarray, ...]:
    """Exact matches (document, window, start) and proximity matches (document, window), each once."""
    n_windows = np.diff(plan.first)
    post = np.flatnonzero(n_windows[shard.term] > 0)
    times = n_windows[shard.term[post]]
    total = np.cumsum(times)
    dense = shard.dense()
    exact, near = [np.empty((0, 3), dtype=np.int64)], [np.empty((0, 2), dtype=np.int64)]
    low = 0
    while low < len(post):
        base = int(total[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(total, base + PIECE, side="right")))
        mine, k = post[low:high], times[low:high]
        low = high
        entry = np.repeat(plan.first[shard.term[mine]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        doc, at = np.repeat(shard.doc[mine], k), np.repeat(shard.position[mine], k)
        window, start = plan.window[entry], at - plan.offset[entry]
        length = plan.tests.length[window].astype(np.int64)
        missing = np.zeros(len(window), dtype=np.int64)
        lack = np.floor(NEAR_LACK * length + 1e-9).astype(np.int64)
        # The shifted lists of the window's terms, rarest first, whether the term stands in its place or only near.
        terms = plan.tests.terms(window).astype(np.int64)
        order = np.argsort(np.where(terms >= 0, plan.rank[terms], len(plan.rank)), axis=1, kind="stable")
        in_place = plan.rarest[entry] & (start >= shard.base[doc]) & (start + length <= shard.base[doc] + shard.n_words[doc])
        left = np.arange(len(window))
        for j in range(WINDOW):
            if not len(left):
                break
            left = left[j < length[left]] if j else left
            place = order[left, j]
            term = terms[left, place]
            in_place[left] &= dense[np.clip(start[left] + place, 0, shard.size - 1)] == term
            reach = length[left] + SLOP
            missing[left] += ~shard.between(term, at[left] - reach + 1, at[left] + reach - 1)
            left = left[missing[left] <= lack[left]]
        some = np.flatnonzero(missing <= lack)
        hit = some[in_place[some]]
        exact.append(np.stack([doc[hit], window[hit], start[hit] - shard.base[doc[hit]]], axis=1))
        some = some[_near(dense, terms[some], length[some], at[some])] if len(some) else some
        near.append(np.stack([doc[some], window[some]], axis=1))
    return np.unique(np.concatenate(exact), axis=0), np.unique(np.concatenate(near), axis=0)


def _search_batches(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    plan = plan.value
    tests = plan.tests
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].values for n in batch.schema.names}
            n_words = row["n_words"].to_numpy().astype(np.int64)
            exact, near = _search(plan, _Shard(n_words, *(row[n].to_numpy().astype(np.int64) for n in ("term", "n_post", "position"))))
            covered: list[list[int]] = [[] for _ in n_words]
            named: list[list[str]] = [[] for _ in n_words]
            cuts = run_starts(exact[:, 0])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                d = int(exact[a, 0])
                mark = np.zeros(n_words[d] + 1, dtype=np.int64)
                np.add.at(mark, exact[a:b, 2], 1)
                np.add.at(mark, exact[a:b, 2] + tests.length[exact[a:b, 1]], -1)
                covered[d] = np.flatnonzero(np.cumsum(mark)[:-1] > 0).tolist()
                named[d] = sorted({tests.names[k] for k in np.unique(tests.item[exact[a:b, 1]]).tolist()} - {None})
            n_near = np.bincount(near[:, 0], minlength=len(n_words))
            columns = [row["doc_id"], row["text_key"], pa.array(n_words), pa.array(covered, type=pa.list_(pa.int32())), pa.array(named, type=pa.list_(pa.string())), pa.array(n_near)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_words", "hits", "items", "n_near"])


def term_counts(docs: DataFrame, tests, text_col: str = "text") -> np.ndarray:
    """Occurrences of each test term over all documents; as many numbers as a block has terms reach the driver."""
    counts = np.zeros(len(tests.value.ids), dtype=np.int64)
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_count_batches, tests=tests), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return counts


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where windows of ``benchmark`` occur in ``docs``.

    One row per row of ``docs``: ``doc_id``, ``text_key`` (a hash of the text), ``n_words``,
    ``hits`` (positions of words inside an occurrence of a window), ``items`` (ids, as
    text, of items with occurring windows) and ``n_near`` (windows of items that have a
    proximity match in the document; those that occur are among them). None depends on
    how ``docs`` is split.

    Null and wordless texts have no words and no hits; items without words have no
    windows, items shorter than a window are one window. Repeated rows give repeated
    rows. Hits of an item with a null id count, but it is not listed. Empty tables give
    an empty result or one without hits. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    found = []
    for block in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        tests = context.broadcast(test_set([tuple(r) for r in mine.collect()]))
        plan = context.broadcast(search_plan(tests.value, term_counts(docs, tests, text_col)))
        index = written(build_index(docs, plan, id_col, text_col))
        found.append(index.mapInArrow(partial(_search_batches, plan=plan), _FOUND))
    if n_blocks == 1:
        return found[0]
    both = found[0]
    for f in found[1:]:
        both = both.union(f)
    merged = both.groupBy("doc_id", "text_key", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sum("n_near").alias("n_near"),
        (F.count(F.lit(1)) / n_blocks).cast("int").alias("copies"),
    )
    one = merged.withColumn("n_near", (F.col("n_near") / F.col("copies")).cast("long"))
    return one.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def without_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, with the columns of ``docs``."""
    i, k = unused(docs, "id", "key")
    found = find_passages(docs, benchmark, id_col, text_col)
    hit = found.where(F.size("hits") > 0).select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(k))
    return docs.join(hit, same, "left_anti")
