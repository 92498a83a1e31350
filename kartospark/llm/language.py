"""Language identification of mixed-language text.

A word's script, told by code point ranges, narrows the languages it can be of to those
that were seen in that script; hashed byte n-grams score it under each of them. Viterbi
over a text's words, with a penalty for switching languages, labels spans; the language
with most words is the text's. How well it fits is the mean log probability of its
n-grams, less what text of those languages has on average: far below for languages that
were never learnt and for random letters.

The model is trained here: counts of n-grams per language over all training texts,
summed by Spark into ``N_BUCKETS`` buckets a language. That table (a few hundred
languages at most exist as labels) is all that reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from kartospark.llm.common import plain_names, slices, unused

N_BUCKETS = 1 << 16
#: Lengths of n-grams, in bytes, word boundaries included.
GRAMS = (2, 3, 4)
#: Cost of switching languages between words, in nats.
SWITCH = 10.0
#: Overlapping n-grams repeat evidence; a word's score is scaled by this.
SCALE = 0.4
SMOOTH = 0.5
#: A language is a candidate for a script that at least this share of its letters' words is in.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
#: Texts less of one language than this share, or that fit worse than this (nats an n-gram), are rejected by a filter.
LEAST_SHARE = 0.25
LEAST_FIT = -4.5
_EXCLUDED = -1e3
_CACHE_WORDS = 200_000
_SLICE = 3 << 20
#: Words whose n-grams are made at once, in bytes; an n-gram takes about a hundred bytes of scratch, and a byte begins three.
_GRAM_SLICE = 1 << 17

#: First code points of script ranges, by the Unicode block charts; each lasts until the next.
SCRIPTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "SouthEastAsian"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB13, "Other"),
    (0x20000, "Han"),
]
_STARTS = [s for s, _ in SCRIPTS]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_NO = [SCRIPT_NAMES.index(n) for _, n in SCRIPTS]
_LATIN = SCRIPT_NAMES.index("Latin")

# ASCII characters that are no letters part words.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split() if text else []


def script(word: bytes) -> int:
    """Number of the script of a word's first letter; -1 for a word without letters."""
    if word[0] < 128:
        return _LATIN
    for c in word.decode("utf-8", "replace"):
        if c.isalpha():
            return _SCRIPT_NO[bisect_right(_STARTS, ord(c)) - 1]
    return -1


def grams(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the word each belongs to."""
    buffer = np.frombuffer(b"\n" + b"\n".join(distinct) + b"\n", dtype=np.uint8)
    edge = buffer == 10
    owner = np.cumsum(edge) - 1
    buckets, owners = [], []
    for n in GRAMS:
        size = len(buffer) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, dtype=np.uint64)
        whole = np.ones(size, dtype=bool)
        for i in range(n):
            h = (h + buffer[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                whole &= ~edge[i : i + size]
        if n == 2:
            whole &= ~(edge[:size] & edge[1 : size + 1])
        buckets.append((h[whole] % np.uint64(N_BUCKETS)).astype(np.int64))
        owners.append(owner[:size][whole])
    return np.concatenate(buckets), np.concatenate(owners)


def numbered(texts: Iterable[str | None], seen: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in ``seen``, to which new words are added, of all words of the texts, and each text's count; no text's words outlive it."""
    counts = []

    def every() -> Iterator[bytes]:
        for text in texts:
            own = words(text)
            counts.append(len(own))
            yield from own

    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in every()), dtype=np.int64)
    return ids, np.array(counts, dtype=np.int64)


def parts(distinct: list[bytes], limit: int = _GRAM_SLICE) -> Iterator[slice]:
    """Cut a list of words so that each part holds about ``limit`` bytes (one long word may exceed it)."""
    total = np.cumsum(np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct)) + 1)
    start = 0
    while start < len(distinct):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield slice(start, stop)
        start = stop


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: keys below ``N_BUCKETS`` are n-grams, the following ones scripts."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            langs = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                seen: dict[bytes, int] = {}
                ids, _ = numbered((t for t, x in zip(texts, langs, strict=True) if x == lang), seen)
                if not len(ids):
                    continue
                times, distinct = np.bincount(ids), list(seen)
                scripts = np.array([script(w) for w in distinct])
                total = totals.setdefault(lang, np.zeros(N_BUCKETS + len(SCRIPT_NAMES)))
                for at in parts(distinct):
                    bucket, owner = grams(distinct[at])
                    total[:N_BUCKETS] += np.bincount(bucket, weights=times[at][owner], minlength=N_BUCKETS)
                total[N_BUCKETS:] += np.bincount(scripts[scripts >= 0], weights=times[scripts >= 0], minlength=len(SCRIPT_NAMES))
    for lang, total in totals.items():
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int32)), pa.array(total[keys].astype(np.int64))], names=["lang", "key", "n"])


class Model(NamedTuple):
    langs: list[str]
    score: np.ndarray  # N_BUCKETS x languages: log probability of an n-gram
    allowed: np.ndarray  # scripts x languages

    def expected(self) -> np.ndarray:
        """Mean log probability of an n-gram of each language's text."""
        return (np.exp(self.score) * self.score).sum(axis=0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row of ``docs`` that has a text and a language."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counted = rows.mapInArrow(_count_batches, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = counted.toArrow().to_pandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((N_BUCKETS + len(SCRIPT_NAMES), len(langs)))
    for i, lang in enumerate(langs):
        mine = table[table["lang"] == lang]
        counts[mine["key"], i] = mine["n"]
    grams_, scripts = counts[:N_BUCKETS], counts[N_BUCKETS:]
    score = np.log((grams_ + SMOOTH) / (grams_.sum(axis=0) + SMOOTH * N_BUCKETS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, score.astype(np.float32), allowed)


def word_scores(model: Model, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words by language, and their numbers of n-grams; 0 for words without letters, scores far below where the script rules a language out."""
    bucket, owner = grams(distinct)
    order = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[order], np.arange(len(distinct)))
    scores = SCALE * np.add.reduceat(model.score[bucket[order]], at, axis=0)
    scripts = np.array([script(w) for w in distinct])
    allowed = model.allowed[scripts]
    scores = np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, _EXCLUDED)
    scores[scripts < 0] = 0
    return scores.astype(np.float32), np.where(scripts < 0, 0, np.bincount(owner, minlength=len(distinct)))


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word of many texts at once; text i has the rows ``starts[i] : starts[i] + counts[i]``.

    Texts advance together, longest first, so that those still running are a prefix.
    """
    n_langs = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    running = len(counts) - np.searchsorted(counts[::-1], np.arange(counts[0] if len(counts) else 0), side="right")
    back = np.zeros(scores.shape, dtype=np.int16)
    best = np.zeros((len(counts), n_langs), dtype=np.float32)
    own = np.arange(n_langs, dtype=np.int16)
    for t, k in enumerate(running):
        at = starts[:k] + t
        v = best[:k]
        if t:
            top = v.argmax(axis=1)
            jump = v[np.arange(k), top] - switch
            stay = v >= jump[:, None]
            back[at] = np.where(stay, own, top[:, None])
            v = np.where(stay, v, jump[:, None])
        best[:k] = v + scores[at]
    label = np.zeros(len(scores), dtype=np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        label[at] = state[:k]
        state[:k] = back[at, state[:k]] if t else state[:k]
    return label


def _label_batches(batches: Iterator[pa.RecordBatch], model, switch: float, spans: bool, text: str, names: list[str], keep: bool = False) -> Iterator[pa.RecordBatch]:
    """``keep``: the column ``text`` is one of the table's own and is returned too."""
    model = model.value
    n_langs = len(model.langs)
    seen: dict[bytes, int] = {}
    scores = np.zeros((0, n_langs), dtype=np.float32)
    lettered = np.zeros(0, dtype=bool)
    n_grams = np.zeros(0, dtype=np.int64)
    expected = model.expected()
    for batch in batches:
        for part in slices(batch, text, _SLICE):
            if len(seen) > _CACHE_WORDS:
                seen, scores, lettered, n_grams = {}, scores[:0], lettered[:0], n_grams[:0]
            known = len(seen)
            ids, counts = numbered(part.column(text).to_pylist(), seen)
            if len(seen) > known:
                new = list(seen)[known:]
                scored = [word_scores(model, new[at]) for at in parts(new)] if n_langs else [(np.zeros((len(new), 0), dtype=np.float32), np.zeros(len(new), dtype=np.int64))]
                scores, n_grams = np.concatenate([scores, *(x for x, _ in scored)]), np.concatenate([n_grams, *(n for _, n in scored)])
                lettered = np.concatenate([lettered, np.array([script(w) >= 0 for w in new])])
            starts = np.cumsum(counts) - counts
            text_of = np.repeat(np.arange(len(counts)), counts)
            has = lettered[ids]
            pred: list[str] = [UNDETERMINED] * len(counts)
            score, fit = np.zeros(len(counts)), np.zeros(len(counts))
            found: list[list[dict]] = [[] for _ in counts]
            if n_langs and len(ids):
                label = viterbi(scores[ids], starts, counts, switch)
                votes = np.bincount(text_of[has] * n_langs + label[has], minlength=len(counts) * n_langs).reshape(-1, n_langs)
                total = votes.sum(axis=1)
                top = votes.argmax(axis=1)
                # Words that their script rules out of all but other languages tell nothing.
                own = scores[ids, label]
                told = has & (own > _EXCLUDED)
                excess = np.bincount(text_of[told], weights=(own / SCALE - n_grams[ids] * expected[label])[told], minlength=len(counts))
                fit = excess / np.maximum(np.bincount(text_of[told], weights=n_grams[ids][told], minlength=len(counts)), 1)
                for i in np.flatnonzero(total):
                    pred[i] = model.langs[top[i]]
                    score[i] = votes[i, top[i]] / total[i]
                cut = np.ones(len(ids), dtype=bool)
                cut[1:] = (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])
                at = np.flatnonzero(cut)
                ends = np.append(at[1:], len(ids))
                for a, b in zip(at.tolist(), ends.tolist(), strict=True) if spans else ():
                    i = text_of[a]
                    if total[i]:
                        found[i].append({"lang": model.langs[label[a]], "start": int(a - starts[i]), "end": int(b - starts[i])})
            rest = part if keep else part.drop_columns([text])
            extra = [pa.array(pred), pa.array(score), pa.array(found, type=_SPAN), pa.array(fit)]
            yield pa.RecordBatch.from_arrays([*rest.columns, *extra], names=[*rest.schema.names, *names])


_SPAN = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


#: Columns that ``identify`` adds.
ADDED = ("lang_pred", "lang_score", "lang_spans", "lang_fit")


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, text_col: str = "text", spans: bool = True, names: tuple[str, ...] | list[str] = ADDED) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (share of lettered words in that language), ``lang_spans`` and ``lang_fit``.

    Spans are word ranges ``(lang, start, end)``, end exclusive, where words are runs of
    letters and non-ASCII characters. Texts that are null or have no letter, and all
    texts under a model without languages, are ``und`` with score and fit 0 and no spans. Texts
    are labelled whole, row by row: repeated rows have equal results, an empty table an
    empty one. Of languages with equally many words the first by name is taken. ``names``
    are the new columns' names; columns of ``docs`` that have them are replaced.
    """
    rows = docs.drop(*(n for n in names if n != text_col))
    # A string column that stays is read as it is: a copy of it would double what goes to the workers.
    own = [f.name for f in rows.schema if f.name.lower() == text_col.lower() and f.dataType == StringType()]
    keep = len(own) == 1 and text_col not in names
    if keep:
        (text,) = own
    else:
        (text,) = unused(rows, "text")
        rows = rows.withColumn(text, F.col(text_col).cast("string")).drop(*(n for n in names if n == text_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(f for f in rows.schema if keep or f.name != text), *(StructField(n, t) for n, t in zip(names, _TYPES, strict=True))])
    return rows.mapInArrow(partial(_label_batches, model=sent, switch=switch, spans=spans, text=text, names=list(names), keep=keep), schema)


_TYPES = (StringType(), DoubleType(), ArrayType(StructType([StructField("lang", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])), DoubleType())


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which a language was found that has a fair share of the words and fits them, with the columns of ``docs``."""
    rows, (text,) = plain_names(docs, text_col)
    pred, score, _, fit = names = unused(rows, *ADDED)
    found = identify(rows, model, text_col=text, spans=False, names=names)
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= LEAST_SHARE) & (F.col(fit) >= LEAST_FIT)).select(*rows.columns).toDF(*docs.columns)
