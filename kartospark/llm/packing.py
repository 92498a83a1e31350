"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents are tokenised and, where longer than a sequence, cut; full pieces are
sequences. The others, one a document at most, and the gaps of open sequences are packed
class by class, a class being the sizes from one to half of it, largest first:

1. Documents of the class and the gaps that can take one are range-sorted together by
   falling size, a gap ahead of a document of its size.
2. Every task sweeps its range: a document takes the smallest gap there is that it fits
   in, and what is left of the gap is a gap at once. Documents without one wait; gaps
   that exceed all sizes of later ranges are on offer there.
3. Waiting documents meet the gaps on offer of the nearest range ahead that has some left.
   Both go by rank, so no two documents want one room: a gap takes as many documents as
   surely fit, the smallest gaps and largest documents first. Only a few numbers of each
   range reach the driver, which pairs stretches of ranks; a join places the documents.
4. Gaps are updated, and rounds repeat while one may place a document. What is left over
   fits nowhere and opens sequences, best fit again, in tasks that get documents of all
   sizes of the class. Then comes the next class.

Equal sizes are told apart by document, so ranges stay even however many are equal. State
is written between rounds. The result is that of sequential best fit by falling size but
for gaps that a document of the same class, but another range, made in the same round.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache, partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kartospark.llm.common import slices, written
from kartospark.sources.shared import discard

CAPACITY = 2048
#: Ends a document.
END_ID = 0
#: Sizes from which on all smaller ones are one class.
SMALL = 64
#: Documents, about, that a task opens sequences for.
OPEN_ROWS = 100_000

PLACED, WAITING, OFFERED, KEPT = range(4)
_ENCODED = "doc_id long, first long, n_ids long, crcs array<long>"
_SWEPT = "kind int, key long, size int, seq long, offset int, part int, rank long"

# Fixed values of byte-level BPE: how it cuts a text into pieces, and the bytes that its vocabulary writes as themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_AS_THEMSELVES = [*range(33, 127), *range(161, 173), *range(174, 256)]


@cache
def encoder(path: str):
    """Encoder of a byte-level BPE file, whose ids follow the order of its merges; the ids of library ``tokenizers`` at a third of its time."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    others = [b for b in range(256) if b not in set(_AS_THEMSELVES)]
    byte_of = {chr(b): b for b in _AS_THEMSELVES} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)


def encoded(text: str | None, path: str) -> np.ndarray:
    """A document's ids, its end included."""
    return np.append(encoder(path).encode_to_numpy(text or "", allowed_special="all"), END_ID).astype("<u4")


def cuts(n: int, capacity: int) -> list[int]:
    """Where pieces of ``n`` ids begin, and ``n``: all are full, but the first may be shorter."""
    return [0, *range(n % capacity or capacity, n, capacity), n]


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Length and checksums of each document's pieces; ``first`` numbers its first piece, the others follow."""
    first = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in slices(batch, "text"):
            rows: dict[str, list] = {"first": [], "n_ids": [], "crcs": [], "ids": []}
            for text in part.column("text").to_pylist():
                ids = encoded(text, path)
                at = cuts(len(ids), capacity)
                pieces = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
                rows["first"].append(first)
                rows["n_ids"].append(len(ids))
                rows["crcs"].append([zlib.crc32(p) for p in pieces])
                rows["ids"].append([p.view("<i4") for p in pieces])
                first += len(pieces)
            columns = [part.column("doc_id"), pa.array(rows["first"], type=pa.int64()), pa.array(rows["n_ids"], type=pa.int64()), pa.array(rows["crcs"], type=pa.list_(pa.int64()))]
            if keep_ids:
                columns.append(pa.array(rows["ids"], type=pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first", "n_ids", "crcs", "ids"][: len(columns)])


def _sweep_batches(batches: Iterator[pa.RecordBatch], capacity: int, opens: bool) -> Iterator[pa.RecordBatch]:
    """One range, by falling size, gaps first: each document to the smallest gap that it fits in.

    Others open a sequence (``opens``) or wait. Gaps not below the range's last size are
    on offer, ranked by size from the smallest; waiting documents rank from the largest.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    part = TaskContext.get().partitionId()
    size, is_gap, key = (np.concatenate([b.column(n).to_numpy() for b in rows]) for n in ("size", "is_gap", "key"))
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # a bit for each size of which there is a gap
    out: list[tuple] = []
    waiting = 0
    for s, gap, k in zip(size.tolist(), is_gap.tolist(), key.tolist(), strict=True):
        if gap:
            gaps[s].append(k)
            there |= 1 << s
            continue
        fitting = there >> s
        if fitting:
            c = s + (fitting & -fitting).bit_length() - 1
            seq = gaps[c].pop()
            if not gaps[c]:
                there ^= 1 << c
        elif opens:
            c, seq = capacity, k
        else:
            out.append((WAITING, k, s, None, None, waiting))
            waiting += 1
            continue
        out.append((PLACED, k, s, seq, capacity - c, None))
        if c > s:
            gaps[c - s].append(seq)
            there |= 1 << (c - s)
    least, rank = int(size[-1]), 0
    for c, seqs in enumerate(gaps):
        for seq in seqs:
            offered = c >= least and not opens
            out.append((OFFERED if offered else KEPT, seq, c, None, None, rank if offered else None))
            rank += offered
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
    kind, k, s, seq, offset, ranks = (pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))
    yield pa.RecordBatch.from_arrays([kind, k, s, seq, offset, pa.array(np.full(len(out), part, dtype=np.int32)), ranks], names=["kind", "key", "size", "seq", "offset", "part", "rank"])


class Range(NamedTuple):
    """What a sweep left of a range."""

    part: int
    waiting: int
    largest: int
    smallest: int
    offered: int
    least_gap: int


class Stretch(NamedTuple):
    """Waiting documents of ranks ``low`` to ``high`` of a range, ``per`` to a gap, to the gaps of a range ahead from rank ``gap_low`` on."""

    link: int
    part: int
    low: int
    high: int
    per: int
    gap_part: int
    gap_low: int
    gap_high: int


def stretches(ranges: list[Range]) -> list[Stretch]:
    """Pairs each range's waiting documents with gaps on offer ahead of it, nearest range first; ranges come by falling size."""
    ahead: list[list[int]] = []  # range, next rank, number of gaps, least size
    out: list[Stretch] = []
    for r in ranges:
        done = 0
        while done < r.waiting and ahead:
            part, at, end, least = ahead[-1]
            per = least // r.largest
            gaps = min(end - at, -(-(r.waiting - done) // per))
            n = min(r.waiting - done, gaps * per)
            out.append(Stretch(len(out), r.part, done, done + n, per, part, at, at + gaps))
            done += n
            ahead[-1][1] += gaps
            if at + gaps == end:
                ahead.pop()
        if r.offered:
            ahead.append([r.part, 0, r.offered, r.least_gap])
    return out


def _swept(docs: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    rows = docs.select("size", F.lit(0).alias("is_gap"), F.col("uid").alias("key")).union(gaps.select("size", F.lit(1).alias("is_gap"), F.col("seq").alias("key")))
    order = [F.col("size").desc(), F.col("is_gap").desc(), F.col("key")]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_sweep_batches, capacity=capacity, opens=False), _SWEPT))


def _opened(docs: DataFrame, n: int, capacity: int) -> DataFrame:
    rows = docs.select("size", F.lit(0).alias("is_gap"), F.col("uid").alias("key"))
    dealt = rows.repartition(-(-n // OPEN_ROWS), F.xxhash64("key")).sortWithinPartitions(F.col("size").desc(), "key")
    return written(dealt.mapInArrow(partial(_sweep_batches, capacity=capacity, opens=True), _SWEPT))


def _ranges(swept: DataFrame) -> list[Range]:
    waits, offers = F.col("kind") == WAITING, F.col("kind") == OFFERED
    found = swept.where(waits | offers).groupBy("part").agg(
        F.count_if(waits).alias("waiting"), F.max(F.when(waits, F.col("size"))).alias("largest"), F.min(F.when(waits, F.col("size"))).alias("smallest"),
        F.count_if(offers).alias("offered"), F.min(F.when(offers, F.col("size"))).alias("least_gap"),
    )
    return sorted(Range(*r) for r in found.select(*Range._fields).collect())


def _met(spark: SparkSession, swept: DataFrame, pairs: list[Stretch], capacity: int) -> DataFrame:
    """Waiting documents of the stretches, placed: ``(uid, seq, offset, size, gap)``, ``gap`` being the gap's size before."""
    table = spark.createDataFrame(pairs, "link int, at int, low long, high long, per long, gap_part int, gap_low long, gap_high long")
    docs = swept.where(F.col("kind") == WAITING).join(F.broadcast(table), (F.col("part") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    docs = docs.select(F.col("key").alias("uid"), "size", "rank", "link", F.expr("(rank - low) div per").alias("place"))
    gaps = swept.where(F.col("kind") == OFFERED).join(F.broadcast(table), (F.col("part") == F.col("gap_part")) & (F.col("rank") >= F.col("gap_low")) & (F.col("rank") < F.col("gap_high")))
    gaps = gaps.select(F.col("key").alias("seq"), F.col("size").alias("gap"), "link", (F.col("rank") - F.col("gap_low")).alias("place"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("link", "place").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.join(gaps, ["link", "place"]).select("uid", "seq", (capacity - F.col("gap") + ahead).cast("int").alias("offset"), "size", "gap")


def _stays(rows: DataFrame, spark: SparkSession, used: dict[int, int]) -> DataFrame:
    """Rows of ranks that are not used up in their range."""
    table = spark.createDataFrame(list(used.items()), "at int, upto long")
    return rows.join(F.broadcast(table), F.col("part") == F.col("at"), "left").where(F.col("rank") >= F.coalesce("upto", F.lit(0)))


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and place of every item: ``(uid, seq, offset)`` of ``(uid long, size int)``.

    Ids are distinct and sizes from 1 to ``capacity``. A sequence has the id of the item
    that opens it; its items lie gapless from 0. An empty table gives an empty result.
    """
    spark = items.sparkSession
    docs = written(items.select("uid", F.col("size").cast("int").alias("size")))
    sizes = sorted(r[0] for r in docs.select("size").distinct().collect())
    gaps, gap_sizes = spark.createDataFrame([], "seq long, size int"), []
    placed = [spark.createDataFrame([], "uid long, seq long, offset int")]

    def found(df: DataFrame) -> None:
        placed.append(df.select("uid", "seq", "offset"))

    def sweeps(swept: DataFrame) -> None:
        found(swept.where(F.col("kind") == PLACED).withColumnRenamed("key", "uid"))

    while sizes:
        high = sizes[-1]
        low = high // 2 if high > SMALL else 0
        least = next(s for s in sizes if s > low)
        todo = docs.where(F.col("size").between(low + 1, high))
        sizes = [s for s in sizes if s <= low]
        while gap_sizes and gap_sizes[-1] >= least:
            swept = _swept(todo, gaps.where(F.col("size") >= least), capacity)
            sweeps(swept)
            ranges = _ranges(swept)
            pairs = stretches(ranges)
            taken: dict[int, int] = {}
            given: dict[int, int] = {}
            for p in pairs:
                taken[p.part] = p.high
                given[p.gap_part] = max(given.get(p.gap_part, 0), p.gap_high)
            left = [r for r in ranges if r.waiting > taken.get(r.part, 0)]
            todo = _stays(swept.where(F.col("kind") == WAITING), spark, taken).select(F.col("key").alias("uid"), "size")
            offered = _stays(swept.where(F.col("kind") == OFFERED), spark, given)
            kept = swept.where(F.col("kind") == KEPT).unionByName(offered.select(*swept.columns)).select(F.col("key").alias("seq"), "size")
            if pairs:
                met = written(_met(spark, swept, pairs, capacity))
                found(met)
                kept = kept.union(met.groupBy("seq").agg((F.max("gap") - F.sum("size")).cast("int").alias("size")).where("size > 0"))
            before, gaps = gaps, written(gaps.where(F.col("size") < least).union(kept))
            discard(before)
            gap_sizes = sorted(r[0] for r in gaps.select("size").distinct().collect())
            if not left:
                todo = None
                break
            least = min(r.smallest for r in left)
        if todo is not None:
            n = todo.count()
            opened = _opened(todo, n, capacity)
            sweeps(opened)
            before, gaps = gaps, written(gaps.union(opened.where(F.col("kind") == KEPT).select(F.col("key").alias("seq"), "size")))
            discard(before)
            gap_sizes = sorted(r[0] for r in gaps.select("size").distinct().collect())
        if sizes:
            gaps, before = written(gaps.where(F.col("size") >= sizes[0])), gaps
            discard(before)
            gap_sizes = [s for s in gap_sizes if s >= sizes[0]]
    return reduce(DataFrame.union, placed)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row for each piece; with ``keep_ids`` also ``ids array<int>``.

    A document is the ids of its text, by the vocabulary in the file ``path``, and an end.
    One longer than ``capacity`` is cut into full pieces, but for the first, which has
    what is over; others are one piece. No sequence holds more than ``capacity`` ids.

    A null text counts as empty: an end alone. Null and repeated ids, and repeated rows,
    are documents of their own. Very long texts are encoded and cut whole. Which of equal
    sizes come together is not defined beyond one run. An empty table gives an empty
    result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _ENCODED + (", ids array<array<int>>" if keep_ids else "")
    made = written(rows.mapInArrow(partial(_encode_batches, path=path, capacity=capacity, keep_ids=keep_ids), schema))
    over = (F.col("n_ids") % capacity).cast("int")
    placed = best_fit(made.where(over > 0).select(F.col("first").alias("uid"), over.alias("size")), capacity)
    head = F.when(over > 0, over).otherwise(F.lit(capacity))
    with_ids = [F.get("ids", F.col("piece")).alias("ids")] if keep_ids else []
    each = made.select("doc_id", "first", head.alias("head"), (over > 0).alias("open"), *(["ids"] if keep_ids else []), F.posexplode("crcs").alias("piece", "ids_crc32"))
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col("head") + (F.col("piece") - 1) * capacity).cast("long")
    length = F.when(F.col("piece") == 0, F.col("head")).otherwise(capacity).cast("long")
    each = each.select("doc_id", "piece", start.alias("start"), length.alias("length"), "ids_crc32", (F.col("first") + F.col("piece")).alias("number"), (F.col("open") & (F.col("piece") == 0)).alias("open"), *with_ids)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = each.where(~F.col("open")).select(*columns, F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *each.columns[7:])
    rest = each.where("open").join(placed, F.col("number") == F.col("uid"))
    return full.union(rest.select(*columns, F.col("seq").alias("sequence_id"), F.col("offset").cast("long"), *each.columns[7:]))


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: ``(sequence_id, ids array<int>, pieces array<struct<offset, doc_id, piece, length>>)``, pieces in order."""
    rows = packed(docs, path, capacity, id_col, text_col, keep_ids=True)
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    made = rows.groupBy("sequence_id").agg(inside.alias("p"))
    return made.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["piece"], x["length"])).alias("pieces"))
