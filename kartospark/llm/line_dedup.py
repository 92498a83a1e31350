"""Line deduplication by an exact set-similarity join.

Lines are sets of words. Lines with equal sets form a class, and similar classes (Jaccard
at least ``THRESHOLD``) link. A line is removed when an earlier line is in its class or in
a linked one.

1. Words order by rarity: hashed counts over the whole corpus (a table of ``N_CELLS``
   numbers, whatever the corpus), then by hash.
2. A set's prefix is its rarest words, so many that similar sets must share one. The
   first word that two similar sets share is in both prefixes; the pair is looked for
   under that word alone. Words that occur once in the corpus are left out.
3. A task's rows of a bucket of prefix words travel as one row and are sorted where they
   meet, so rows of one prefix word meet in one place. Length and positional filters and a
   parity map of about a bit a word (two sets differ in at least as many words as bits)
   discard pairs exactly, without the sets. Rows of a pair that is left stay in the run.
4. Only classes that stayed somewhere are fetched, with their sets, which are written once;
   of texts without such a class most are told by a map of bits before texts are shuffled.
   They meet again in the same runs, in the same rounds, and the pairs that are left there
   are verified: no others are ever tried. A pair counts in the run of the first word that
   it shares, so once.

Runs of one word longer than ``block`` are cut into pairs of blocks over many tasks, row
by row; words of ``WIDE`` occurrences or more are not even gathered in a bucket before.
Links are counted in place; pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartospark.llm.common import as_bytes, plain_names, run_starts, slices, written
from kartospark.sources.shared import discard, forget

THRESHOLD = 0.8
N_CELLS = 1 << 21
#: Cells that are summed together.
CHUNK = 4096
#: Rows of one prefix word compared inside one task; a longer run is cut into pairs of blocks.
BLOCK = 4096
#: Rounds in which runs meet, each those of its share of the words, so that only a part of all rows is on disk at once.
ROUNDS = 2
#: Buckets of prefix words for each shuffle partition; a bucket's rows travel in packets and are compared together.
BUCKETS = 16
#: Postings that a task holds before it packs them.
PACKED = 1 << 20
#: Words with so many occurrences are not gathered by word before their runs are cut.
WIDE = 1 << 20
#: Bits of the map by which texts without a wanted line are left out before texts are shuffled.
N_SLOTS = 1 << 24
#: Text handled at once; its words' dictionary stays small.
_SLICE = 1 << 20
_FOUR = 4  # smaller sets have no similar set but themselves
_LINES = pa.list_(pa.struct([("line", pa.int32()), ("class", pa.int64())]))
_DOC = "doc_id long, text_key long, lines array<struct<line:int,class:long>>, bucket int, keys binary, classes binary, packed binary, parity binary"


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, as far as a text has needed them."""

    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.append(np.uint64(1), np.full(n, x))) for x in (cls.base, cls.inverse))
        return cls.up[:n], cls.down[:n]


_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of the texts (A-Z in lower case), the word's line counted through all texts, and each text's first line.

    A word's hash is a polynomial of its bytes: a sum of bytes times powers, scaled back
    by the power that the word starts at, then mixed. So words cost a few array passes.
    """
    joined = b"\n".join(t or b"" for t in texts).lower() + b"\n"
    buffer = np.frombuffer(joined, dtype=np.uint8)
    blank = _BLANK[buffer]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        change = np.append(0, change)
    start = change[::2]
    up, down = _Powers.upto(len(buffer))
    sums = np.add.reduceat((buffer + np.uint64(1)) * up, change)[::2] if len(change) else np.empty(0, dtype=np.uint64)
    token = _mixed(sums * down[start])
    breaks = np.flatnonzero(buffer == 10)
    text_start = np.cumsum([0, *(len(t or b"") + 1 for t in texts[:-1])]) if texts else np.empty(0, dtype=np.int64)
    return token, np.searchsorted(breaks, start), np.searchsorted(breaks, text_start)


def _tokens(texts: list[bytes | None], level: np.ndarray):
    """Lines with words of many texts: text and line number of each, and the distinct words of each, by rarity, then hash.

    Returns ``text_of``, ``line_no``, ``start`` (of a line's words, closed by the total), ``token`` and its level.
    """
    token, line, first = _words(texts)
    full, row = np.unique(line, return_inverse=True) if len(line) else (line, line)
    text_of = np.searchsorted(first, full, side="right") - 1
    bits = np.uint64(max(1, int(len(full)).bit_length()))
    lv = level[_cell(token)]
    # One number to sort by: line, level, leading bits of the hash.
    key = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (lv.astype(np.uint64) << (np.uint64(56) - bits)) | (token >> (np.uint64(8) + bits))
    order = np.argsort(key)
    token, lv, row = token[order], lv[order], row[order]
    once = np.append(True, (token[1:] != token[:-1]) | (row[1:] != row[:-1])) if len(token) else np.empty(0, dtype=bool)
    token, lv, row = token[once], lv[once], row[once]
    return text_of, full - first[text_of], np.searchsorted(row, np.arange(len(full) + 1)), token, lv


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _map_words(size: np.ndarray, per: int = 64) -> np.ndarray:
    """64-bit words of a set's parity map: one for each ``per`` words of the line, rounded up to a power of two, at most 32."""
    return 1 << np.minimum(5, np.ceil(np.log2(np.maximum(size, per) / per)).astype(np.int64))


def _classes(start: np.ndarray, token: np.ndarray, per: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class hash of each line's set, and parity maps as words with offsets."""
    size = np.diff(start)
    words = _map_words(size, per)
    offset = np.append(0, np.cumsum(words))
    flat = np.zeros(offset[-1], dtype=np.uint64)
    if not len(size):
        return np.empty(0, dtype=np.uint64), flat, offset
    cls = _mixed(np.add.reduceat(_mixed(token), start[:-1]) + size.astype(np.uint64))
    bit = np.uint64(1) << (token & np.uint64(63))
    flat[offset[:-1]] = np.bitwise_xor.reduceat(bit, start[:-1])
    long = np.repeat(words > 1, size)
    if long.any():
        row = np.repeat(np.arange(len(size)), size)[long]
        flat[np.repeat(offset[:-1][words > 1], words[words > 1]) + np.concatenate([np.arange(w) for w in words[words > 1]])] = 0
        at = offset[row] + (token[long] >> np.uint64(6)).astype(np.int64) % words[row]
        np.bitwise_xor.at(flat, at, bit[long])
    return cls, flat, offset


def _maps(flat: np.ndarray, offset: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offset) - 1, [None, pa.py_buffer((8 * offset).astype(np.int32)), pa.py_buffer(flat)])


class _Parity:
    """Parity maps of rows; two are compared at the length of the shorter, to which the longer folds."""

    def __init__(self, column: pa.Array, order: np.ndarray):
        offset = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
        self.flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[: 8 * int(offset[-1])].view(np.uint64)
        self.start, self.words = offset[:-1][order], np.diff(offset)[order]
        self.one = self._folded(np.arange(len(order)), 1)

    def _folded(self, rows: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros((len(rows), k), dtype=np.uint64)
        most = self.words[rows]
        for turn in range(0, int(most.max(initial=0)), k):
            on = most > turn
            out[on] ^= self.flat[(self.start[rows[on]] + turn)[:, None] + np.arange(k)]
        return out

    def close(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Pairs whose maps differ in at most ``most`` bits."""
        one = self.one[:, 0]
        ok = np.bitwise_count(one[i] ^ one[j]) <= most
        k = np.minimum(self.words[i], self.words[j])
        for level in (2, 4, 8, 16, 32):
            at = np.flatnonzero(ok & (k == level))
            if len(at):
                ok[at] = np.bitwise_count(self._folded(i[at], level) ^ self._folded(j[at], level)).sum(axis=1, dtype=np.int64) <= most[at]
        return ok


def _cell(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(20)).astype(np.int64) % N_CELLS


def _word_hashes(texts: list[bytes | None]) -> np.ndarray:
    return _words(texts)[0]


def _count_batches(batches: Iterator[pa.RecordBatch], tokens=_word_hashes) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words, in chunks of ``CHUNK`` cells."""
    total = np.zeros(N_CELLS, dtype=np.int32)
    for batch in batches:
        cells = [_cell(tokens(as_bytes(part.column("text")))) for part in slices(batch, "text", _SLICE // 4)]
        if cells:
            total += np.bincount(np.concatenate(cells), minlength=N_CELLS).astype(np.int32)
    chunks = total.reshape(-1, CHUNK)
    there = np.flatnonzero(chunks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([chunks[i].tobytes() for i in there], type=pa.binary())], names=["chunk", "counts"])


def _level_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the chunks that a task has all counts of."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, dtype=np.int32).astype(np.int64)
    levels = [np.where(n > 1, np.minimum(255, 1 + np.floor(np.log2(np.maximum(n, 1)) * 5)), 0).astype(np.uint8).tobytes() for n in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array(levels, type=pa.binary())], names=["chunk", "levels"])


def rarity(docs: DataFrame, tokens=_word_hashes) -> np.ndarray:
    """Level of each cell: 0 if its words occur once in all, else one more than the logarithm of their count, in fifths."""
    counts = docs.select("text").mapInArrow(partial(_count_batches, tokens=tokens), "chunk int, counts binary")
    level = np.zeros((N_CELLS // CHUNK, CHUNK), dtype=np.uint8)
    for r in counts.repartition("chunk").mapInArrow(_level_batches, "chunk int, levels binary").collect():
        level[r["chunk"]] = np.frombuffer(r["levels"], dtype=np.uint8)
    return level.ravel()


def _prefix(size: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Words of which a set shares one with every similar set that is no larger than needed."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of stretches that begin at ``start``, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def _packets(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row for each bucket in postings ``(bucket, key, class, packed, words of each map, maps)``."""
    bucket, key, cls, packed, words, flat = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(bucket, kind="stable")
    runs = run_starts(bucket[order])
    start = np.cumsum(words) - words
    ends = np.append(0, np.cumsum(words[order]))[runs]
    columns = [_maps(x[order], runs) for x in (key, cls, packed)] + [_maps(flat[_stretches(start[order], words[order])], ends)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][runs[:-1]].astype(np.int32)), *columns], names=["bucket", "keys", "classes", "packed", "parity"])


def _line_batches(batches: Iterator[pa.RecordBatch], level, buckets: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Each text's lines with their classes, and apart from them packets of postings: a class under each prefix word that may occur elsewhere.

    Words that occur once are the first of a prefix and left out; a class's words are
    listed once a task. A packet holds the postings of a bucket of words; those of words
    that occur ``wide`` times or more are dealt by class, to buckets beyond the others.
    """
    level, seen = level.value, set()
    many = 1 + int(np.log2(wide) * 5)
    found: list[tuple[np.ndarray, ...]] = []
    names = [x.split()[0] for x in _DOC.split(", ")]

    def packets() -> pa.RecordBatch:
        made = _packets(found)
        found.clear()
        return pa.RecordBatch.from_arrays([*(pa.nulls(made.num_rows, t) for t in (pa.int64(), pa.int64(), _LINES)), *made.columns], names=names)

    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            text_of, line_no, start, token, lv = _tokens(as_bytes(part.column("text")), level)
            cls, flat, offset = _classes(start, token)
            size = np.diff(start)
            fresh = np.zeros(len(cls), dtype=bool)
            for i in np.unique(cls, return_index=True)[1].tolist():
                c = int(cls[i])
                if size[i] >= _FOUR and c not in seen:
                    seen.add(c)
                    fresh[i] = True
            row = np.repeat(np.arange(len(cls)), size)
            at = np.flatnonzero(fresh[row] & (np.arange(len(token)) - start[row] < _prefix(size)[row]) & (lv > 0))
            if len(at):
                of, key = row[at], token[at]
                bucket = np.where(lv[at] < many, key % np.uint64(buckets), np.uint64(buckets) + cls[of] % np.uint64(buckets))
                words = np.diff(offset)[of]
                found.append((bucket, key, cls[of], (size[of] << 32) + (at - start[of] << 2), words, flat[_stretches(offset[of], words)]))
            lines = pa.StructArray.from_arrays([pa.array(line_no.astype(np.int32)), pa.array(cls.view(np.int64))], names=["line", "class"])
            nested = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(part.num_rows + 1)).astype(np.int32)), lines)
            none = [pa.nulls(part.num_rows, t) for t in (pa.int32(), *[pa.binary()] * 4)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), nested.cast(_LINES), *none], names=names)
            if sum(len(x[0]) for x in found) >= PACKED:
                yield packets()
    if found:
        yield packets()


def _needed(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Least overlap of similar sets of these sizes."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _may_match(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Pairs of rows that length, position and parity leave; rows without a position may match anywhere.

    In a run of two blocks only pairs across them count.
    """
    a, b = r["size"][i], r["size"][j]
    need = _needed(a, b, threshold)
    ok = (np.minimum(a - r["position"][i], b - r["position"][j]) >= need) & ((r["half"][i] == 2) | (r["half"][i] != r["half"][j]))
    ok[np.flatnonzero(ok)] = r["parity"].close(i[ok], j[ok], (a + b - 2 * need)[ok])
    return ok


def _pairs(r: dict[str, np.ndarray], starts: np.ndarray, threshold: float = THRESHOLD, longest: int | None = None):
    """Candidate pairs within runs, in pieces of bounded size; rows of a run are sorted by size. Runs beyond ``longest`` rows are left out."""
    n = int(starts[-1])
    end = np.repeat(starts[1:], np.diff(starts))
    rows = np.arange(n)
    # Sizes ascend, so partners of a row lie in a stretch behind it.
    span = r["run"] * (1 << 32)
    last = np.minimum(np.searchsorted(span + r["size"], span + np.floor(r["size"] / threshold + 1e-9).astype(np.int64), side="right"), end)
    todo = last - rows - 1
    if longest is not None:
        todo[np.repeat(np.diff(starts) > longest, np.diff(starts))] = 0
    total = np.cumsum(todo)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + 1_000_000, side="right")))
        k = todo[at:stop]
        i = np.repeat(rows[at:stop], k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        ok = _may_match(r, i, j, threshold)
        yield i[ok], j[ok]
        at = stop


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end with a run of ``key``, of rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(run_starts(key)[-2])
        new = bool(held) and key[0] != held[-1].column("key")[-1].as_py()
        held.append(batch)
        if cut or new:
            rows = pa.Table.from_batches(held)
            upto = rows.num_rows - batch.num_rows + cut
            yield rows.slice(0, upto)
            held = rows.slice(upto).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _sorted_runs(rows: pa.Table, names: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows by run and size, one row a class and run; also the places they had."""
    r = {n: rows.column(n).to_numpy() for n in ["key", *names]}
    return _runs(r, rows.column("parity").combine_chunks())


def _runs(r: dict[str, np.ndarray], parity: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """``_sorted_runs`` of columns sorted by ``key``."""
    r["size"], r["position"], r["half"] = r["packed"] >> 32, r["packed"] >> 2 & 0x3FFFFFFF, r["packed"] & 3
    runs = run_starts(r["key"])
    run = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
    order = np.lexsort((r["class"], r["size"], run))
    cls, run = r["class"][order], run[order]
    once = np.append(True, (cls[1:] != cls[:-1]) | (run[1:] != run[:-1]))
    order = order[once]
    out = {k: v[order] for k, v in r.items()} | {"run": run[once].astype(np.int64)}
    out["size"] = out["size"].astype(np.int64)
    out["parity"] = _Parity(parity, order)
    return out, np.searchsorted(out["run"], np.arange(len(runs))), order


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows is connected to by the pairs."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _staying(r: dict[str, np.ndarray], starts: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows that are in a surviving pair of a run of at most ``longest`` rows."""
    stays = np.zeros(len(r["class"]), dtype=bool)
    for i, j in _pairs(r, starts, longest=longest):
        stays[i] = stays[j] = True
    return stays


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each run that are in a surviving pair."""
    for rows in _whole_runs(batches):
        r, starts, _ = _sorted_runs(rows, ["class", "packed"])
        stays = _staying(r, starts)
        yield pa.RecordBatch.from_arrays([pa.array(r[n][stays]) for n in ("key", "class", "packed")], names=["key", "class", "packed"])


def _unpacked(packets: pa.Table, alone: bool) -> tuple[dict[str, np.ndarray], pa.Array]:
    """Postings of packets, sorted by word, and their parity maps; those that are ``alone`` under their word only if asked for."""
    key, cls, packed, flat = (np.frombuffer(b"".join(packets.column(n).to_pylist()), dtype=np.int64) for n in ("keys", "classes", "packed", "parity"))
    words = _map_words(packed >> 32)
    start = np.cumsum(words) - words
    order = np.argsort(key)
    length = np.diff(run_starts(key[order]))
    order = order[np.repeat(alone | (length > 1), length)]
    maps = _maps(flat[_stretches(start[order], words[order])], np.append(0, np.cumsum(words[order])))
    return {"key": key[order], "class": cls[order], "packed": packed[order]}, maps


def _bucket_batches(batches: Iterator[pa.RecordBatch], buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of each run of a bucket that are in a surviving pair.

    Of runs longer than ``block``, and of buckets from ``buckets`` on, all rows are told,
    with their parity maps: their runs are still to be cut.
    """
    names = ["key", "class", "packed", "parity"]
    for rows in _whole_runs(batches):
        cuts = run_starts(rows.column("key").to_numpy())
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            wide = rows.column("key")[a].as_py() >= buckets
            told, maps = _unpacked(rows.slice(a, b - a), wide)
            if wide:
                yield pa.RecordBatch.from_arrays([*map(pa.array, told.values()), maps], names=names)
            elif len(maps):
                r, starts, order = _runs(told | {"packed": told["packed"] + 2}, maps)
                stays, long = _staying(r, starts, block), np.repeat(np.diff(starts) > block, np.diff(starts))
                yield pa.RecordBatch.from_arrays([*(pa.array(r[n][stays]) for n in names[:3]), pa.nulls(int(stays.sum()), pa.binary())], names=names)
                if long.any():
                    yield pa.RecordBatch.from_arrays([*(pa.array(told[n][order[long]]) for n in names[:3]), maps.take(pa.array(order[long]))], names=names)


class _Sets:
    """Sets of numbered words, whose overlaps are looked up in one sorted list of row and word."""

    def __init__(self, word: np.ndarray, start: np.ndarray, size: np.ndarray, n_words: int):
        self.word, self.start, self.size, self.n = word, start, size, n_words
        self.known = np.sort(np.repeat(np.arange(len(size)), size) * n_words + word[_stretches(start, size)])

    def overlaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sizes of intersections of pairs of sets."""
        size = self.size[i]
        pair = np.repeat(np.arange(len(i)), size)
        if not len(pair) or not len(self.known):
            return np.zeros(len(i), dtype=np.int64)
        wanted = j[pair] * self.n + self.word[_stretches(self.start[i], size)]
        there = self.known[np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)] == wanted
        return np.bincount(pair[there], minlength=len(i))


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each class in the runs of its words, and whether one of them is to an earlier class."""
    for rows in _whole_runs(batches):
        r, starts, order = _sorted_runs(rows, ["class", "packed", "rank_id", "rank_line"])
        words = rows.column("words").combine_chunks()
        offsets = words.offsets.to_numpy().astype(np.int64)
        distinct, word = np.unique(words.values.to_numpy(), return_inverse=True)
        sets = _Sets(word, offsets[order], r["size"], len(distinct))
        before = _Sets(word, offsets[order], r["position"], len(distinct))  # words ahead of the run's own
        n_links = np.zeros(len(order), dtype=np.int64)
        beaten = np.zeros(len(order), dtype=bool)
        rank = np.empty(len(order), dtype=np.int64)
        rank[np.lexsort((r["class"], r["rank_line"], r["rank_id"]))] = np.arange(len(order))
        for i, j in _pairs(r, starts):
            for at in range(0, len(i), 10_000):
                x, y = i[at : at + 10_000], j[at : at + 10_000]
                first = before.overlaps(x, y) == 0
                x, y = x[first], y[first]
                common = sets.overlaps(x, y)
                linked = common >= THRESHOLD * (r["size"][x] + r["size"][y] - common) - 1e-9
                x, y = x[linked], y[linked]
                np.add.at(n_links, x, 1)
                np.add.at(n_links, y, 1)
                beaten[np.where(rank[x] > rank[y], x, y)] = True
        hit = n_links > 0
        yield pa.RecordBatch.from_arrays([pa.array(r["class"][hit]), pa.array(n_links[hit]), pa.array(beaten[hit])], names=["class", "n_links", "beaten"])


def _set_batches(batches: Iterator[pa.RecordBatch], level) -> Iterator[pa.RecordBatch]:
    """Sets of the wanted lines of each text, with what is known of them."""
    level = level.value
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            text_of, line_no, start, token, _ = _tokens(as_bytes(part.column("text")), level)
            cls, flat, offset = _classes(start, token)
            maps = _maps(flat, offset)
            wanted = [{w["line"]: w for w in x} for x in part.column("wanted").to_pylist()]
            at = [k for k, (i, line) in enumerate(zip(text_of.tolist(), line_no.tolist(), strict=True)) if line in wanted[i]]
            told = [wanted[text_of[k]][line_no[k]] for k in at]
            columns = [pa.array([t["rank_id"] for t in told], type=pa.int64()), pa.array(line_no[at]), pa.array(cls[at].view(np.int64)), maps.take(pa.array(at, type=pa.int64()))]
            sets = pa.array([token[start[k] : start[k + 1]].view(np.int64) for k in at], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, sets], names=["rank_id", "rank_line", "class", "parity", "words"])


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of one ``key`` together and sorted; runs in ``hot`` are cut into pairs of their ``n`` blocks.

    ``packed`` holds a set's size from bit 32, the word's position from bit 2 and, in the
    last bits, which block of the pair the row is of, or 2 where a run is one block.
    """
    cut = hot.select(F.col("key").alias("h"), "n")
    mine = F.pmod(F.xxhash64("class"), F.col("n")).cast("int")

    def pair(o: Column) -> Column:
        number = F.least(o, mine) * F.col("n") + F.greatest(o, mine)
        half = F.when(o == mine, 2).otherwise((mine > o).cast("int"))
        return F.struct(F.xxhash64("key", number).alias("key"), (F.col("packed") + half).alias("packed"))

    whole = F.array(F.struct(F.col("key"), (F.col("packed") + 2).alias("packed")))
    rest = [c for c in rows.columns if c not in ("key", "packed")]
    split = rows.join(cut, F.col("key") == F.col("h"), "left").select(*rest, F.inline(F.when(F.col("n").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), pair))))
    return split.repartition("key").sortWithinPartitions("key")


def _hot(keys: DataFrame, block: int) -> DataFrame:
    """Keys of more than ``block`` rows, with their number of blocks; written, so that its size is known to the join."""
    return written(keys.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``texts`` that may be ``wanted``, by a map of ``N_SLOTS`` bits: all that are and a share of the others, as many as bits are set."""
    slot = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(N_SLOTS))
    page, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    pages = wanted.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return texts.join(F.broadcast(pages), page == F.col("page")).where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("page", "bits")


def marked_lines(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(uid, doc_id, text_key, line, class, n_links, removed)``, one row for each line with a word.

    ``line`` counts from 0 within the text, blank lines included; ``class`` is shared by
    lines of equal word sets (A-Z in lower case); ``n_links`` is the number of other
    classes that are similar. Of a class all but the first line are removed, and the
    first too if a linked class begins earlier. Lines order by id (null last), line
    number and, where ids repeat, file order.

    Null and blank texts have no lines. Repeated rows are texts of their own: the later
    one's lines are removed. Very long lines and texts are compared whole. Empty tables
    give empty results. Other columns are not read.
    """
    _, each, told = _marked(docs, block, id_col, text_col)
    return _with_classes(each, told).select("uid", "doc_id", "text_key", "line", "class", "n_links", "removed")


def _with_classes(each: DataFrame, told: DataFrame) -> DataFrame:
    """Lines with what is known of their class, and whether they are removed."""
    first = (F.col("uid") == F.col("first_uid")) & (F.col("line") == F.col("first_line"))
    return each.join(told, F.col("class") == F.col("c")).withColumn("removed", ~first | F.col("beaten"))


def _marked(docs: DataFrame, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All texts ``(uid, doc_id, text_key, lines)``, their lines, and classes with their size, first line and links."""
    context = docs.sparkSession.sparkContext
    rows = _keyed(docs, id_col, text_col)
    level = context.broadcast(rarity(rows))
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = written(rows.mapInArrow(partial(_line_batches, level=level, buckets=buckets, wide=max(WIDE, block)), _DOC).withColumn("uid", F.monotonically_increasing_id()))
    lines = made.where("bucket is null").select("uid", "doc_id", "text_key", "lines")
    each = lines.select("uid", "doc_id", "text_key", F.explode("lines").alias("x")).select("uid", "doc_id", "text_key", "x.line", "x.class")
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "line", "uid", "doc_id", "text_key")

    packets = made.where("bucket is not null").select(F.col("bucket").alias("key"), "keys", "classes", "packed", "parity")
    met = partial(_bucket_batches, buckets=buckets, block=block)
    rounds = [written(packets.where(F.col("key") % ROUNDS == i).repartition("key").sortWithinPartitions("key").mapInArrow(met, "key long, class long, packed long, parity binary")) for i in range(ROUNDS)]
    long = reduce(DataFrame.unionByName, rounds).where("parity is not null")
    cut = written(_dealt(long, _hot(long.select("key"), block)).mapInArrow(_candidate_batches, "key long, class long, packed long"))
    parts = [part.where("parity is null").drop("parity").unionByName(cut.where(F.pmod("key", F.lit(ROUNDS)) == i)) for i, part in enumerate(rounds)]
    found = reduce(DataFrame.unionByName, parts)
    del packets, long
    forget(docs.sparkSession)
    classes = written(each.groupBy("class").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).select("class", "n", "first.*"))

    wanted = classes.join(found.select("class").distinct(), "class", "left_semi")
    by_text = written(wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line", F.col("id").alias("rank_id"))).alias("wanted")))
    texts = _likely(rows, by_text).join(by_text.withColumnsRenamed({"doc_id": "w_id", "text_key": "w_key"}), _same("doc_id", "w_id") & (F.col("text_key") == F.col("w_key"))).dropDuplicates(["doc_id", "text_key"])
    sets = written(texts.select("text", "wanted").mapInArrow(partial(_set_batches, level=level), "rank_id long, rank_line long, class long, parity binary, words array<long>").withColumnRenamed("class", "c"))
    discard(by_text)
    del found, wanted, by_text, texts
    forget(docs.sparkSession)
    verified = []
    for part in parts:
        met = part.join(sets, F.col("class") == F.col("c")).drop("c").repartition("key").sortWithinPartitions("key")
        verified.append(written(met.mapInArrow(_verify_batches, "class long, n_links long, beaten boolean")))
        del met
        forget(docs.sparkSession)
    discard(sets, cut, *rounds)
    links = written(reduce(DataFrame.unionByName, verified).groupBy("class").agg(F.sum("n_links").alias("n_links"), F.max("beaten").alias("beaten")))
    discard(*verified)
    told = classes.join(links, "class", "left").select(F.col("class").alias("c"), "n", F.col("uid").alias("first_uid"), F.col("line").alias("first_line"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("beaten", F.lit(False)).alias("beaten"))
    return lines, each, told


def by_document(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, n_lines, n_removed, n_links, kept)``, one row for each row of ``docs``.

    ``kept`` lists line numbers; rows without lines have none and 0 in every count.
    """
    texts, each, told = _marked(docs, block, id_col, text_col)
    # Lines alone in their class and without links are kept and count for nothing.
    counted = _with_classes(each.select("uid", "line", "class"), told.where("n > 1 or n_links > 0")).groupBy(F.col("uid").alias("u")).agg(
        F.count_if("removed").alias("n_removed"),
        F.sum("n_links").alias("n_links"),
        F.collect_list(F.when(F.col("removed"), F.col("line"))).alias("gone"),
    )
    joined = texts.select("uid", "doc_id", "text_key", F.col("lines.line").alias("line")).join(counted, F.col("uid") == F.col("u"), "left")
    counts = [F.size("line").cast("long").alias("n_lines"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_removed", "n_links"))]
    return joined.select("doc_id", "text_key", *counts, F.array_except("line", F.coalesce("gone", F.array().cast("array<int>"))).alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without removed lines in its texts; blank lines stay, rows without lines are as they were.

    Of repeated rows all get the text that is left of the first.
    """
    rows, (id_col, text_col) = plain_names(docs, id_col, text_col)
    found = by_document(rows, block, id_col, text_col).where("n_removed > 0")
    best = found.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.max_by("kept", F.size("kept")).alias("keep"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = rows.join(best, F.col(id_col).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("key")), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    blank = F.lit(r"^[\x20\x09-\x0D]*$")
    kept = F.array_join(F.filter(lines, lambda x, n: F.array_contains("keep", n) | F.regexp_like(x, blank)), "\n")
    return joined.withColumn(text_col, F.when(F.col("keep").isNull(), F.col(text_col)).otherwise(kept)).select(*rows.columns).toDF(*docs.columns)
