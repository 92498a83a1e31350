"""Scoring of documents by language models: a smoothed unigram model and a gated recurrent one.

Spark counts every token of the training text. Words beyond the ``N_FREQUENT`` most
frequent are looked up by an equi-join of their hashes with the count table, so no
dictionary that grows with the corpus is ever sent to tasks.

The recurrent model (``gru``) has the ``N_MODELLED`` most frequent words in closed
classes, rarer words in larger ones. All other words fall into open classes by their last bytes;
within an open class a word has its smoothed relative count, unseen words together one
more share, so every text has a proper probability.

Every training text trains it, in one of ``ROUNDS`` rounds. A round's texts are dealt by
hash to groups of about ``GROUP_BYTES``; each group runs truncated backpropagation over
its texts from the same weights, and the weights are averaged. Groups and their order
follow from the texts alone, so the model does not depend on how a table is split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartospark.llm import gru
from kartospark.llm.common import slices, written

SMOOTH = 0.1
#: Most words whose counts are sent to all tasks.
N_FREQUENT = 1 << 17
N_MODELLED = 1023
N_CLOSED = 24
N_OPEN = 16
ROUNDS = 3
#: Training text of one group, and the most groups of a round; beyond that groups grow.
GROUP_BYTES = 8 << 20
MAX_GROUPS = 1 << 14
_FLUSH = 300_000
_SLICE = 4 << 20
#: Text scored at once; more, as the longest text of each takes steps of its own.
_SCORE_SLICE = 8 << 20
_LN10 = float(np.log(10))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Blank-separated words of the texts with A-Z in lower case: how many each text has, their numbers, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    coded = lists.flatten().dictionary_encode()
    number = coded.indices.to_numpy()
    counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
    distinct = coded.dictionary.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()
    if b"" in distinct:  # the one word of a text without any
        full = number != distinct.index(b"")
        counts -= np.bincount(np.repeat(np.arange(len(counts)), counts)[~full], minlength=len(counts))
        number = number[full]
    return counts, number, distinct


def open_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % N_OPEN


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(seen: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), type=pa.binary()), pa.array(seen.values(), type=pa.int64())], names=["word", "n"])

    seen: dict[bytes, int] = {}
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            _, number, distinct = words(part.column("text"))
            times = np.bincount(number, minlength=len(distinct)).tolist()
            for word, n in zip(distinct, times, strict=True):
                if n:
                    seen[word] = seen.get(word, 0) + n
            if len(seen) > _FLUSH:
                yield out(seen)
                seen = {}
    yield out(seen)


def _open_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smoothed mass of the open classes: sums over a task's words."""
    mass = np.zeros(N_OPEN)
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            mass[open_class(word)] += n + SMOOTH
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_OPEN, dtype=np.int32)), pa.array(mass)], names=["cls", "mass"])


class Lexicon(NamedTuple):
    """Counts of frequent words, by falling count; the first ones are modelled, the others are in open classes."""

    ids: dict[bytes, int]
    counts: np.ndarray
    #: Class of each frequent word; closed classes come first.
    cls: np.ndarray
    shape: gru.Shape
    end: int  # word number of the end token
    number: np.ndarray  # word number within the closed classes, -1 for open ones
    open_mass: np.ndarray
    n_tokens: int
    n_types: int


def count(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all rows' texts, written to the shared folder."""
    return written(docs.select("text").mapInArrow(_count_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``N_FREQUENT`` words, all with more than some count; the rest of that count is left out as a whole."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["step"], r["k"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in sizes:
        if total + k > N_FREQUENT:
            break
        total, least = total + k, s
    if least is None:
        return []
    table = counts.where(step >= least).toArrow().to_pandas()
    pairs = [(bytes(w), int(n)) for w, n in zip(table["word"], table["n"], strict=True)]
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


def lexicon(counts: DataFrame, n_texts: int) -> Lexicon:
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_words, n_types = total[0] or 0, total[1]
    frequent = _frequent(counts)
    modelled = frequent[:N_MODELLED]
    # Closed classes: runs of the modelled words by falling count, of about equal sums of the counts' square roots, which makes
    # the number of words normalised over for a token about least; the end token is a class of its own.
    mass = np.sqrt(np.array([n for _, n in modelled], dtype=np.float64))
    before = np.cumsum(mass) - mass
    group = np.minimum((before / max(mass.sum(), 1) * (N_CLOSED - 1)).astype(int), N_CLOSED - 2) if len(mass) else np.empty(0, dtype=int)
    _, group = np.unique(group, return_inverse=True)
    n_groups = int(group.max(initial=-1)) + 1
    starts = np.append(np.searchsorted(group, np.arange(n_groups)), [len(mass), len(mass) + 1]).astype(np.int64)
    shape = gru.Shape(starts, N_OPEN)
    cls = np.array([group[i] if i < len(mass) else shape.n_closed + open_class(w) for i, (w, _) in enumerate(frequent)], dtype=np.int32)
    number = np.where(np.arange(len(frequent)) < len(mass), np.arange(len(frequent)), -1)
    sums = counts.mapInArrow(_open_batches, "cls int, mass double").groupBy("cls").agg(F.sum("mass").alias("mass")).collect()
    open_mass = np.full(N_OPEN, SMOOTH)  # one more share for all unseen words of the class
    for r in sums:
        open_mass[r["cls"]] += r["mass"]
    for w, n in modelled:
        open_mass[open_class(w)] -= n + SMOOTH
    return Lexicon({w: i for i, (w, _) in enumerate(frequent)}, np.array([n for _, n in frequent], dtype=np.int64), cls, shape, len(mass), number, np.maximum(open_mass, SMOOTH), n_words + n_texts, n_types + (n_texts > 0))


def start_weights(lex: Lexicon, n_texts: int) -> gru.Params:
    word_mass = np.append(lex.counts[: lex.end] + SMOOTH, n_texts + SMOOTH)
    class_mass = np.append(np.add.reduceat(word_mass, lex.shape.starts[:-1]), lex.open_mass)
    return gru.initial(lex.shape, class_mass, word_mass)


def _encode(lex: Lexicon, texts: pa.Array, hashes: bool = True):
    """Tokens of texts, each closed by the end token.

    Returns ``ids`` (frequent word, -1 another, -2 end), class, word and input number of
    each token, tokens of each text, and where words that are not frequent stand, with
    their hashes (where asked for).
    """
    counts, number_of, distinct = words(texts)
    id_of = np.fromiter(map(lex.ids.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
    known = id_of >= 0
    others = np.flatnonzero(~known)
    other_words = [distinct[i] for i in others.tolist()]
    cls_of = np.empty(len(distinct), dtype=np.int64)
    cls_of[known] = lex.cls[id_of[known]]
    cls_of[others] = lex.shape.n_closed + np.fromiter(map(open_class, other_words), dtype=np.int64, count=len(others))
    hash_of = np.zeros(len(distinct), dtype=np.uint64)
    if hashes:
        hash_of[others] = np.fromiter(map(xxhash.xxh64_intdigest, other_words, repeat(42)), dtype=np.uint64, count=len(others))
    word_of = np.full(len(distinct), -1, dtype=np.int64)
    word_of[known] = lex.number[id_of[known]]
    counts = counts + 1
    is_word = np.ones(int(counts.sum()), dtype=bool)
    is_word[np.cumsum(counts) - 1] = False
    ids = np.full(len(is_word), -2, dtype=np.int64)
    cls = np.full(len(ids), lex.shape.n_closed - 1, dtype=np.int64)
    number = np.full(len(ids), lex.end, dtype=np.int64)
    ids[is_word], cls[is_word], number[is_word] = id_of[number_of], cls_of[number_of], word_of[number_of]
    inputs = np.where(number >= 0, number, lex.shape.n_words + cls - lex.shape.n_closed)
    rare_at = np.flatnonzero(ids == -1)
    word_row = np.cumsum(is_word) - 1
    return ids, cls, number, inputs, counts, rare_at, hash_of[number_of[word_row[rare_at]]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """Texts of one group after another, in pieces of about ``_SLICE`` bytes that do not depend on the batches."""
    at, held, size = None, [], 0
    for batch in batches:
        texts, start = batch.column("text"), 0
        for i, (group, n) in enumerate(zip(batch.column("group").to_pylist(), pc.binary_length(texts).to_pylist(), strict=True)):
            if at is not None and (group != at or size >= _SLICE):
                yield at, pa.concat_arrays([*held, texts.slice(start, i - start)])
                held, start, size = [], i, 0
            at = group
            size += n or 0
        held.append(texts.slice(start))
    if at is not None:
        yield at, pa.concat_arrays(held)


def _train_batches(batches: Iterator[pa.RecordBatch], lex, weights: np.ndarray, like: gru.Params) -> Iterator[pa.RecordBatch]:
    """Weights that a task's groups arrive at, as sums weighted by tokens."""
    lex, total, n, at, trainer = lex.value, np.zeros(len(weights) + 1), 0, None, None
    for group, texts in chain(_pieces(batches), [(None, None)]):
        if group != at:
            if trainer is not None:
                total += n * np.append(1.0, trainer.flat)
            at, n, trainer = group, 0, gru.Trainer(weights, like, lex.shape)
        if texts is not None:
            _, cls, number, inputs, counts, _, _ = _encode(lex, texts, hashes=False)
            trainer.fit(inputs, cls, number, np.cumsum(counts) - counts, counts)
            n += int(counts.sum())
    if total[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(weights), dtype=np.int32)), pa.array(total)], names=["at", "value"])


def train(docs: DataFrame, lex: Lexicon, n_texts: int, lex_sent, n_bytes: int, group_bytes: int = GROUP_BYTES) -> gru.Params:
    """Train on every row of ``docs`` (``doc_id, text``, of ``n_bytes`` of text in all), each in one round."""
    like = start_weights(lex, n_texts)
    weights = gru.pack(like)
    n_groups = int(np.clip(-(-n_bytes // (ROUNDS * group_bytes)), 1, MAX_GROUPS))
    rows = docs.select(F.xxhash64("text", "doc_id").alias("h"), "text").withColumn("group", F.pmod(F.shiftright("h", 8), F.lit(n_groups)).cast("int"))
    for i in range(ROUNDS):
        dealt = rows.where(F.pmod("h", F.lit(ROUNDS)) == i).repartitionById(n_groups, "group").sortWithinPartitions("group", "h").select("group", "text")
        sums = dealt.mapInArrow(partial(_train_batches, lex=lex_sent, weights=weights, like=like), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().to_pandas()
        if len(sums):
            at = sums.set_index("at")["value"].sort_index()
            weights = (at.loc[0:].to_numpy() / at.loc[-1]).astype(np.float32)
    return gru.unpack(weights, like)


_SCORED = "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<h:long,n:long>>"


def _score_batches(batches: Iterator[pa.RecordBatch], lex, params, n_texts: int) -> Iterator[pa.RecordBatch]:
    """Scores without the counts of rare words, and those words by hash."""
    lex, params = lex.value, params.value
    z = np.log10(lex.n_tokens + SMOOTH * (lex.n_types + 1))
    log_count = np.log10(np.append(lex.counts + SMOOTH, [n_texts + SMOOTH, 1.0]))  # last: rare words, added by the join
    log_mass = np.log10(lex.open_mass)
    for batch in batches:
        for part in slices(batch, "text", _SCORE_SLICE):
            ids, cls, number, inputs, counts, rare_at, hashes = _encode(lex, part.column("text"))
            starts = np.cumsum(counts) - counts
            text_of = np.repeat(np.arange(len(counts)), counts)
            of_count = log_count[np.where(ids >= 0, ids, np.where(ids == -2, len(lex.counts), len(lex.counts) + 1))]
            base = np.add.reduceat(of_count, starts) - counts * z
            is_open = cls >= lex.shape.n_closed
            model = gru.total_log_prob(params, lex.shape, inputs, cls, number, starts, counts) / _LN10
            model[is_open] += of_count[is_open] - log_mass[cls[is_open] - lex.shape.n_closed]
            known = np.add.reduceat(((ids >= 0) | (ids == -2) & (n_texts > 0)).astype(np.int64), starts)
            hashes, owner = hashes.view(np.int64), text_of[rare_at]
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            pairs = pa.StructArray.from_arrays([pa.array(hashes[at]), pa.array(np.diff(np.append(at, len(hashes))))], names=["h", "n"])
            offsets = np.searchsorted(owner[at], np.arange(len(counts) + 1)).astype(np.int32)
            columns = [part.column("doc_id"), pa.array(counts), pa.array(known), pa.array(base), pa.array(np.add.reduceat(model, starts)), pa.ListArray.from_arrays(pa.array(offsets), pairs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base", "score", "rare"])


def scored(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Rows where ``training`` is true are learnt from; scores are log10 probabilities of
    whole texts, end token included. A null text is an empty one: its end token alone.
    Texts are never cut; a very long one only makes its stream longer (in training its
    stretches of ``gru.STRETCH`` tokens start anew). Repeated rows
    have equal scores and count as often as they occur. Without training text only the
    end token's and unseen words' shares are left, and scores are finite. An empty table
    gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learnt = rows.where("training")
    n_texts, n_bytes = learnt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    counts = count(learnt)
    lex = lexicon(counts, n_texts)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(lex)
    params = context.broadcast(train(learnt.select("doc_id", "text"), lex, n_texts, sent, n_bytes))
    marked = rows.select("doc_id", "text").mapInArrow(partial(_score_batches, lex=sent, params=params, n_texts=n_texts), _SCORED)
    marked = written(marked.withColumn("uid", F.monotonically_increasing_id()))
    hashed = counts.select(F.xxhash64("word").alias("ch"), F.col("n").alias("c"))
    looked = marked.select("uid", F.inline("rare")).join(hashed, F.col("h") == F.col("ch"), "left")
    c = F.coalesce("c", F.lit(0))
    rare = looked.groupBy(F.col("uid").alias("r")).agg(F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("more"), F.sum(F.when(c > 0, F.col("n"))).alias("seen"))
    joined = marked.join(rare, F.col("uid") == F.col("r"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(lex.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
