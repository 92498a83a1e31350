"""Fill-in-the-middle by ropes.

A text is a binary tree, a rope. Leaves hold pieces of text; every node knows how many
units (code points, or matches of a pattern) and code points lie below it, so a cut at a
unit's rank walks one path down and copies one leaf. A text is cut at two ranks into
prefix, middle and suffix; the three trees are joined in another order with sentinels in
between, and only then made a string again. The inverse builds a rope of the output,
cuts it before and behind the sentinels and joins the parts in their first order.

Every decision is drawn from sha256 of a document's id, so reruns agree and rows are
independent: one pass over the table, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kartospark.llm.common import slices

#: Marks ahead of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a leaf, about.
LEAF = 4096
#: Percent of texts that are rearranged, and of those the percent whose suffix leads.
RATE, SPM_RATE = 90, 20

PLAIN, PSM, SPM = "plain", "psm", "spm"


class Rope(NamedTuple):
    """A leaf (``text``) or two subtrees, with the units and code points below."""

    units: int
    chars: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0, "")


def leaf(text: str, units: int | None = None) -> Rope:
    return Rope(len(text) if units is None else units, len(text), text)


def joined(a: Rope, b: Rope) -> Rope:
    """Both, one after the other; no text is copied."""
    if not a.chars:
        return b
    return a if not b.chars else Rope(a.units + b.units, a.chars + b.chars, None, a, b)


def _ends(text: str, unit: re.Pattern | None) -> list[int]:
    """Where the units of a text end: matches from left to right, each with what lies ahead of it; what is left at the end is one more."""
    out = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    return out if not text or out and out[-1] == len(text) else [*out, len(text)]


def _balanced(leaves: list[Rope]) -> Rope:
    while len(leaves) > 1:
        leaves = [joined(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def rope(text: str, unit: re.Pattern | None = None, size: int = LEAF) -> Rope:
    """A balanced tree of leaves that end with a unit; units are code points unless a pattern is given, which must not look around itself."""
    if unit is None:
        return _balanced([leaf(text[i : i + size]) for i in range(0, len(text), size)])
    leaves, start, n = [], 0, 0
    for end in _ends(text, unit):
        n += 1
        if end - start >= size or end == len(text):
            leaves.append(leaf(text[start:end], n))
            start, n = end, 0
    return _balanced(leaves)


def split(tree: Rope, rank: int, unit: re.Pattern | None = None) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if rank <= 0 or rank >= tree.units:
        return (EMPTY, tree) if rank <= 0 else (tree, EMPTY)
    if tree.text is not None:
        at = rank if unit is None else _ends(tree.text, unit)[rank - 1]
        return leaf(tree.text[:at], rank), leaf(tree.text[at:], tree.units - rank)
    if rank < tree.left.units:
        a, b = split(tree.left, rank, unit)
        return a, joined(b, tree.right)
    a, b = split(tree.right, rank - tree.left.units, unit)
    return joined(tree.left, a), b


def text_of(tree: Rope) -> str:
    parts, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.text is None:
            todo += (node.right, node.left)
        else:
            parts.append(node.text)
    return "".join(parts)


class Draw(NamedTuple):
    first: int
    second: int
    rearranged: int
    order: int


def drawn(doc_id: int | None, seed: int = 1) -> Draw:
    """Four numbers from the sha256 of seed and id; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return Draw(*(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)))


class Transformed(NamedTuple):
    output: str
    form: str
    units: int
    #: Code points of prefix and middle, none where the text is plain.
    prefix: int | None
    middle: int | None


def transform(text: str, d: Draw, unit: re.Pattern | None = None, rate: int = RATE, spm_rate: int = SPM_RATE) -> Transformed:
    tree = rope(text, unit)
    if not text or any(s in text for s in SENTINELS) or d.rearranged % 100 >= rate:
        return Transformed(text, PLAIN, tree.units, None, None)
    low, high = sorted((d.first % (tree.units + 1), d.second % (tree.units + 1)))
    head, suffix = split(tree, high, unit)
    prefix, middle = split(head, low, unit)
    p, s, m = ((leaf(mark, 1), part) for mark, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    form = SPM if d.order % 100 < spm_rate else PSM
    out = EMPTY
    for part in (*s, *p, *m) if form == SPM else (*p, *s, *m):
        out = joined(out, part)
    return Transformed(text_of(out), form, tree.units, prefix.chars, middle.chars)


def restore(output: str, form: str) -> str:
    """The text that ``transform`` made ``output`` of; a rearranged text has each sentinel once, as texts with one stay plain."""
    if form == PLAIN:
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == SPM else (PREFIX, SUFFIX, MIDDLE)
    rest, parts = rope(output), {}
    for mark, at in sorted(((m, output.index(m)) for m in order), key=lambda x: -x[1]):
        rest, part = split(rest, at)
        parts[mark] = split(part, len(mark))[1]
    return text_of(joined(joined(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def _transform_batches(batches: Iterator[pa.RecordBatch], unit: str | None, seed: int, rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    pattern = None if unit is None else re.compile(unit)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            rows = [transform(t or "", drawn(i, seed), pattern, rate, spm_rate) for i, t in zip(ids, texts, strict=True)]
            columns = [pa.array([getattr(r, n) for r in rows], type=t) for n, t in (("units", pa.int64()), ("form", pa.string()), ("prefix", pa.int64()), ("middle", pa.int64()), ("output", pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transformed(docs: DataFrame, unit: str | None = None, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row for each row of ``docs``.

    ``n`` counts a text's units: code points or, with a pattern ``unit``, its matches from
    left to right (what lies between two belongs to the later). A text is ``plain`` and as
    it was if it is empty, holds a sentinel or falls outside ``rate`` percent; else it is
    cut at two drawn ranks, equal ones included, and ``psm`` or ``spm``.

    A null text counts as empty, a null id draws as an empty one; equal ids draw alike.
    Very long texts are cut as any other. Repeated rows stay, an empty table gives an
    empty result, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_transform_batches, unit=unit, seed=seed, rate=rate, spm_rate=spm_rate), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _restore_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "output"):
            texts = [restore(o, f) for o, f in zip(part.column("output").to_pylist(), part.column("form").to_pylist(), strict=True)]
            yield part.append_column("restored", pa.array(texts, type=pa.string()))


def restored(made: DataFrame) -> DataFrame:
    """``made``, rows of ``transformed``, with ``restored``: each text again, from ``output`` and ``form`` alone."""
    return made.mapInArrow(_restore_batches, StructType([*made.schema.fields, StructField("restored", StringType())]))
