"""Quality rules run as a short-circuit cascade.

A rule needs measures of a text (its words, its symbols, ...), and rules share them. On a
sample, in Spark tasks, every measure is timed and every rule tried. The order is built
greedily: next comes the rule that rejects most of the sample's texts still left per
second that its measures, but for those that earlier rules have paid for, take on them.
Each rule then runs only on texts that all earlier ones let pass. The order changes what
a pass costs, never which rows it keeps.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartospark.llm.common import as_bytes, plain_names, slices

#: Rows, on average, on which costs and rejection rates are measured.
SAMPLE_ROWS = 2000
#: Words in a window whose repetition counts.
REPEAT_WINDOW = 5

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\v\f\r"
_DIGITS = bytes(range(48, 58))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


class Text:
    """One text and its measures, each computed when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    def count(self, chars: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, chars))

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.raw.decode("utf-8", "replace")) - self.count(_BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return self.count(_SYMBOLS)

    @cached_property
    def full_lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.full_lines) - len(set(self.full_lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by windows of ``REPEAT_WINDOW`` words that occur twice or more in the text."""
        n = self.n_words - REPEAT_WINDOW + 1
        if n < 2:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), dtype=np.int64, count=self.n_words)
        window = ids[:n]
        for step in range(1, REPEAT_WINDOW):  # numbers of ever longer runs of words; no hash, so no false match
            window = window * len(seen) + ids[step : step + n]
            if step < REPEAT_WINDOW - 1 and len(seen) ** (step + 2) >= 1 << 62 or step == REPEAT_WINDOW - 1:
                window = np.unique(window, return_inverse=True)[1]
        twice = np.bincount(window)[window] > 1
        edge = np.zeros(self.n_words + 1, dtype=np.int64)
        edge[:n] += twice
        edge[REPEAT_WINDOW:] -= twice
        return int((np.cumsum(edge[:-1]) > 0).sum())

    @cached_property
    def n_echoes(self) -> int:
        """Words equal to the word before."""
        return sum(a == b for a, b in zip(self.words, self.words[1:], strict=False))


    @cached_property
    def n_upper(self) -> int:
        return self.count(_UPPER)

    @cached_property
    def n_letters(self) -> int:
        return self.count(_LETTERS)

    @cached_property
    def n_digits(self) -> int:
        return self.count(_DIGITS)

    @cached_property
    def n_exclamations(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def n_bullets(self) -> int:
        """Lines with a word that begin with a bullet."""
        return sum(x.startswith((b"- ", b"* ", b"\xe2\x80\xa2")) for x in self.full_lines)

    @cached_property
    def n_trailing(self) -> int:
        """Lines with a word that end with an ellipsis."""
        return sum(x.endswith((b"...", b"\xe2\x80\xa6")) for x in self.full_lines)


class Rule(NamedTuple):
    """``passes`` may look at the measures named in ``needs`` only."""

    needs: tuple[str, ...]
    passes: Callable[[Text], bool]


#: Rules that a text must all pass, by name.
RULES: dict[str, Rule] = {
    "enough_words": Rule(("n_words",), lambda t: t.n_words >= 10),
    "few_repeats": Rule(("n_words", "n_repeat_words"), lambda t: 100 * t.n_repeat_words <= 20 * t.n_words),
    "few_symbols": Rule(("n_words", "n_symbols"), lambda t: 10 * t.n_symbols <= t.n_words),
    "no_shouting": Rule(("n_upper", "n_letters"), lambda t: 10 * t.n_upper <= 3 * t.n_letters),
    "few_exclamations": Rule(("n_words", "n_exclamations"), lambda t: 10 * t.n_exclamations <= t.n_words),
    "few_echoes": Rule(("n_words", "n_echoes"), lambda t: 10 * t.n_echoes <= t.n_words),
    "few_dup_lines": Rule(("full_lines", "n_dup_lines"), lambda t: 2 * t.n_dup_lines <= len(t.full_lines)),
    "word_length": Rule(("n_words", "word_chars"), lambda t: 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    "few_digits": Rule(("word_chars", "n_digits"), lambda t: 2 * t.n_digits <= t.word_chars),
    "few_bullets": Rule(("full_lines", "n_bullets"), lambda t: 10 * t.n_bullets <= 9 * len(t.full_lines)),
    "few_trailing": Rule(("full_lines", "n_trailing"), lambda t: 10 * t.n_trailing <= 3 * len(t.full_lines)),
}
#: Rules of the base verdict; the others are the cascade's own.
BASE = ("enough_words", "few_repeats")
#: Measures in an order in which none needs a later one.
MEASURES = list(dict.fromkeys(m for r in RULES.values() for m in r.needs))


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sample's texts, those that fail the same rules together: the rules as bits, texts, and seconds of each measure."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [Text(raw) for raw in as_bytes(part.column("text"))]
            seconds = []
            for name in MEASURES:
                began = time.perf_counter()
                for t in texts:
                    getattr(t, name)
                seconds.append(time.perf_counter() - began)
            fails = Counter(sum(1 << i for i, r in enumerate(RULES.values()) if not r.passes(t)) for t in texts)
            shares = [[x * n / len(texts) for x in seconds] for n in fails.values()]
            yield pa.RecordBatch.from_pydict({"fails": pa.array(fails, type=pa.int32()), "n": pa.array(fails.values(), type=pa.int64()), "seconds": pa.array(shares, type=pa.list_(pa.float64()))})


class Step(NamedTuple):
    rule: str
    #: Share of the sample's texts that reach the rule and that it rejects.
    rejects: float
    #: Seconds a text of what the rule is first to need.
    seconds: float


def ordered(fails: np.ndarray, seconds: dict[str, float], n: np.ndarray | None = None) -> list[Step]:
    """Rules by falling rejection per cost among the texts that earlier rules let pass, each measure paid for once.

    ``fails`` has a row for each text of the sample, or for ``n`` texts alike, and a column for each rule. Ties go by the order of ``RULES``.
    """
    n = np.ones(len(fails)) if n is None else n
    left, paid, names, out = np.ones(len(fails), dtype=bool), set(), list(RULES), []
    while names:

        def step(name: str) -> Step:
            rejects = np.average(fails[left, list(RULES).index(name)], weights=n[left]) if left.any() else 0.0
            return Step(name, float(rejects), sum(seconds[m] for m in RULES[name].needs if m not in paid))

        best = max((step(n) for n in names), key=lambda s: s.rejects / max(s.seconds, 1e-9))
        out.append(best)
        names.remove(best.rule)
        paid.update(RULES[best.rule].needs)
        left &= ~fails[:, list(RULES).index(best.rule)]
    return out


def measured(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Step]:
    """The cascade's order, from about ``sample_rows`` rows, each drawn on its own, so that copies of one row are drawn as any others.

    The tasks sum what they find by the rules that a text fails; these sums, at most one for each set of rules, are
    all that reaches the driver. A table of fewer rows is measured whole; without any row the order is that of ``RULES``.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    picked = docs.select(F.col(text_col).cast("string").alias("text"))
    if share < 1:
        picked = picked.where(F.rand(11) < share)
    sums = [F.sum(F.get("seconds", F.lit(i))).alias(m) for i, m in enumerate(MEASURES)]
    found = picked.mapInArrow(_measure_batches, "fails int, n long, seconds array<double>").groupBy("fails").agg(F.sum("n").alias("n"), *sums).collect()
    if not found:
        return [Step(n, 0.0, 0.0) for n in RULES]
    n = np.array([r["n"] for r in found])
    fails = np.array([[r["fails"] >> i & 1 for i in range(len(RULES))] for r in found], dtype=bool)
    return ordered(fails, {m: sum(r[m] for r in found) / n.sum() for m in MEASURES}, n)


def cascade(text: Text, order: list[str]) -> str | None:
    """The first rule in ``order`` that rejects the text; later ones, and what they alone need, are not computed."""
    return next((n for n in order if not RULES[n].passes(text)), None)


_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _report_batches(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [Text(raw) for raw in as_bytes(part.column("text"))]
            rejected = [cascade(t, order) for t in texts]
            failed = [not all(RULES[n].passes(t) for n in BASE) for t in texts]
            measures = [pa.array([getattr(t, n) for t in texts], type=pa.int64()) for n in _METRICS]
            columns = [part.column("doc_id"), *measures, pa.array(failed, type=pa.bool_()), pa.array([r is None for r in rejected], type=pa.bool_()), pa.array(rejected, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_METRICS, "base_failed", "kept", "rejected_by"])


def report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict and measures of every row: ``doc_id``, five measures, ``base_failed``, ``kept`` and ``rejected_by``.

    All rules run as one cascade; ``rejected_by`` is the first that rejects, so it depends
    on the measured order, which ``kept`` does not. The measures are output of their own,
    computed for every row. A null text counts as empty, fails ``enough_words`` and is not
    kept. Very long texts are measured whole. Repeated rows and ids are rows like any
    other. An empty table gives an empty result. Other columns are not read.
    """
    order = [s.rule for s in measured(docs, sample_rows, text_col)]
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in _METRICS) + ", base_failed boolean, kept boolean, rejected_by string"
    return picked.mapInArrow(partial(_report_batches, order=order), schema)


def _keep_batches(batches: Iterator[pa.RecordBatch], order: list[str], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            keep = [i for i, raw in enumerate(as_bytes(part.column(text))) if cascade(Text(raw), order) is None]
            yield part.take(pa.array(keep, type=pa.int64())).drop_columns([text])


def kept(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with the columns of ``docs``, whatever their names; all rules run as a cascade."""
    rows, (col,) = plain_names(docs, text_col)
    order = [s.rule for s in measured(rows, sample_rows, col)]
    return rows.withColumn("text", F.col(col).cast("string")).mapInArrow(partial(_keep_batches, order=order, text="text"), rows.schema).toDF(*docs.columns)
