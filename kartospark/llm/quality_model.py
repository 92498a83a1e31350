"""Quality classifier by positive-unlabelled learning.

Only trusted positives carry a label; all other text is unlabelled. The classifier is
linear over bounded features of a text, those of its shape and the shares of its words
by hashed bucket, and minimises the non-negative unbiased risk of Kiryo et al. (2017)

    R(g) = pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

with the squared loss l(z) = (1 - z)^2 / 4. With this loss both expectations depend on
the data through first and second moments of the features alone, so one pass of Spark
sums covers every positive and every unlabelled text, and the minimisation itself runs
on two small matrices, exactly as full-batch descent over the whole corpus would.

The class prior pi is estimated by the best-bin bound: over sets of high scores of a
naive classifier, the least ratio of the share of unlabelled to that of positive texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartospark.llm.common import as_bytes, slices, written
from kartospark.llm.lm import words
from kartospark.llm.quality_rules import Text

#: Width of the saturating transform x / (x + KNEE) of ratios that are near zero in prose.
KNEE = 0.05
#: Bins of a score histogram for the class prior.
BINS = 200
#: Least share of the positives in a set that bounds the prior.
LEAST_TOP = 0.2
#: Penalty of squared weights, and that of words' weights at one positive, which falls with the root of the positives' number:
#: a few trusted texts do not show which words good texts have, and words must not tell them from the like that nobody has trusted yet.
RIDGE, LEXICAL_RIDGE = 1e-3, 50.0
STEPS = 2000

SHAPE = ("one", "symbols", "exclamations", "digits", "uppercase", "echoes", "repeats", "dup_lines", "few_distinct", "long_words", "short_words", "blank")
#: Buckets that words hash into.
N_LEXICAL = 64
N_FEATURES = len(SHAPE) + N_LEXICAL


def shape(text: Text) -> list[float]:
    n = text.n_words
    if not n:
        return [1.0] + [0.0] * (len(SHAPE) - 2) + [1.0]

    def knee(x: float) -> float:
        return x / (x + KNEE)

    mean, distinct = text.word_chars / n, len(set(text.words))
    return [
        1.0,
        knee(text.n_symbols / n),
        knee(text.n_exclamations / n),
        knee(text.n_digits / len(text.raw)),
        max(0.0, text.n_upper / max(1, text.n_letters) - 0.2) / 0.8,
        knee(text.n_echoes / n),
        text.n_repeat_words / n,
        text.n_dup_lines / max(1, len(text.full_lines)),
        1.0 - distinct / n**0.9 if n > 20 and distinct < n**0.9 else 0.0,
        min(1.0, max(0.0, mean - 8.0) / 8.0),
        min(1.0, max(0.0, 4.0 - mean) / 4.0),
        0.0,
    ]


def lexical(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of each text's words (A-Z in lower case) by bucket; texts without words have none."""
    counts, number, distinct = words(texts)
    bucket = np.array([zlib.crc32(w) % N_LEXICAL for w in distinct], dtype=np.int64)
    at = np.repeat(np.arange(len(counts)), counts) * N_LEXICAL + bucket[number]
    share = np.bincount(at, minlength=len(counts) * N_LEXICAL).reshape(-1, N_LEXICAL) / np.maximum(counts, 1)[:, None]
    return np.sqrt(share)


def features(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.array([shape(Text(raw)) for raw in as_bytes(texts)]).reshape(-1, len(SHAPE)), lexical(texts)], axis=1).astype(np.float32)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(part.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], names=["doc_id", "x"])


def featurised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)`` for every row; null and wordless texts have the ``blank`` feature alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_feature_batches, "doc_id long, x array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)


def _positive(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)


def _moment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's rows of x xT, for positives (group 1) and all rows (group 0)."""
    d = N_FEATURES
    total = np.zeros((2, d * d))
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            p = x[_positive(batch)]
            total += [(x.T @ x).ravel(), (p.T @ p).ravel()]
    group, at = np.divmod(np.arange(2 * d * d), d * d)
    yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total.ravel())], names=["group", "at", "value"])


def moments(rows: DataFrame) -> np.ndarray:
    """Second moments ``(2, d, d)`` of all rows and of the positives; the feature ``one`` makes them hold counts and means."""
    d = N_FEATURES
    sums = rows.select("x", "positive").mapInArrow(_moment_batches, "group int, at int, value double").groupBy("group", "at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((2, d * d))
    for r in sums:
        out[r["group"], r["at"]] = r["value"]
    return out.reshape(2, d, d)


def _bin_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray, low: float, high: float) -> Iterator[pa.RecordBatch]:
    """A task's rows and positives by bin of the linear score."""
    n = np.zeros((2, BINS), dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            at = np.clip((_matrix(batch) @ weights - low) / max(high - low, 1e-9) * BINS, 0, BINS - 1).astype(np.int64)
            n += [np.bincount(at, minlength=BINS), np.bincount(at[_positive(batch)], minlength=BINS)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(n[0]), pa.array(n[1])], names=["bin", "n", "p"])


def _score_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            # The minimiser of the squared loss is twice the probability, less one.
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip((_matrix(batch) @ weights + 1) / 2, 0, 1))], names=["doc_id", "score"])


class Model(NamedTuple):
    weights: np.ndarray
    prior: float


def _ridge(n_positive: float) -> np.ndarray:
    return np.repeat([RIDGE, LEXICAL_RIDGE / np.sqrt(n_positive)], [len(SHAPE), N_LEXICAL])


def naive_weights(sums: np.ndarray) -> np.ndarray:
    """The least-squares classifier of positives against all rows."""
    everything, positive = sums
    n_u, n_p = everything[0, 0], positive[0, 0]
    return np.linalg.solve(everything / n_u + positive / n_p + np.diag(_ridge(n_p)), positive[0] / n_p - everything[0] / n_u)


def best_bin(u: np.ndarray, p: np.ndarray) -> float:
    """Least ratio of the shares of all rows and of positives in a set of the highest bins that holds enough positives."""
    top_u, top_p = np.cumsum(u[::-1]) / u.sum(), np.cumsum(p[::-1]) / p.sum()
    enough = top_p >= LEAST_TOP
    return float(np.clip((top_u[enough] / top_p[enough]).min(), 0.05, 0.95))


def class_prior(rows: DataFrame, sums: np.ndarray) -> float:
    """Best-bin estimate over score sets ``{g >= t}`` of the naive classifier."""
    naive = naive_weights(sums)
    most = float(np.abs(naive).sum())
    u, p = np.zeros(BINS), np.zeros(BINS)
    binned = rows.select("x", "positive").mapInArrow(partial(_bin_batches, weights=naive, low=-most, high=most), "bin int, n long, p long")
    for r in binned.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect():
        u[r["bin"]], p[r["bin"]] = r["n"], r["p"]
    return best_bin(u, p)


def risk(w: np.ndarray, m_u: np.ndarray, m_p: np.ndarray, e_u: np.ndarray, e_p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk from mean second and first moments, and the step's gradient: where the negative part is below zero, its gradient is taken back."""

    def half(sign: float, m: np.ndarray, e: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean of l(sign * g) and its gradient."""
        return (1 - 2 * sign * e @ w + w @ m @ w) / 4, (m @ w - sign * e) / 2

    loss_p, grad_p = half(1, m_p, e_p)
    loss_pn, grad_pn = half(-1, m_p, e_p)
    loss_u, grad_u = half(-1, m_u, e_u)
    negative, grad = loss_u - prior * loss_pn, grad_u - prior * grad_pn
    return prior * loss_p + max(0.0, negative), prior * grad_p + grad if negative >= 0 else -grad


def minimise(sums: np.ndarray, prior: float) -> np.ndarray:
    """Gradient descent on the risk over standardised features."""
    everything, positive = sums
    m_u, m_p = everything / everything[0, 0], positive / positive[0, 0]
    scale = 1 / np.sqrt(np.diag(m_u) + 1e-6)
    m_u, m_p = m_u * np.outer(scale, scale), m_p * np.outer(scale, scale)
    e_u, e_p = m_u[0] / scale[0], m_p[0] / scale[0]
    w, ridge = np.zeros(len(scale)), _ridge(positive[0, 0])
    rate = 1 / (float(np.linalg.eigvalsh(m_u + m_p)[-1]) / 2 + ridge.max())  # below the inverse of the greatest curvature
    for _ in range(STEPS):
        w -= rate * (risk(w, m_u, m_p, e_u, e_p, prior)[1] + ridge * w)
    return w * scale


def train(rows: DataFrame) -> Model:
    """Learn from ``rows`` of ``(x, positive)``; all rows are the unlabelled sample, positives included.

    Without positives the prior is 0.5 and every score 0.5.
    """
    sums = moments(rows)
    if not sums[1, 0, 0]:
        return Model(np.zeros(N_FEATURES), 0.5)
    prior = class_prior(rows, sums)
    return Model(minimise(sums, prior), prior)


def scored(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``, learnt from the documents whose id is in ``trusted`` (``doc_id``).

    Ids, languages, sources and labels are no inputs of a score. Null and blank texts get
    a score too. Texts are read whole; repeated rows have equal scores; null ids are
    never trusted. An empty table gives an empty result. Other columns are not read.
    """
    ids = trusted.select(F.col("doc_id").alias("t_id")).where("t_id is not null").distinct()
    # Rows without an id join nothing and would meet in one task; they are set apart before anything is computed.
    has_id = F.col(id_col).cast("long").isNotNull()
    known = written(featurised(docs.where(has_id), id_col, text_col)).join(ids, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "x", F.col("t_id").isNotNull().alias("positive"))
    marked = written(known.union(featurised(docs.where(~has_id), id_col, text_col).select("doc_id", "x", F.lit(False))))
    return marked.select("doc_id", "x").mapInArrow(partial(_score_batches, weights=train(marked).weights), "doc_id long, score double")
