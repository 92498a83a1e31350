import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kartospark.llm import fill_middle
from kartospark.llm.fill_middle import Draw
from kartospark.llm.queries import QUERIES
from llm_cases import EDGE

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_rows_equal_brute_force(spark, documents):
    rows = EDGE + [(30 + i, t) for i, t in enumerate(["<P>", "a<S>b", "x <M> y", "<P", "S><", "<<P<S", "é" * 10_000, "a\U0001f600" * 9000, "\x00 nul"])] + [(-5, "negative id")]
    made = fill_middle.restored(fill_middle.transformed(documents(rows))).collect()
    got = sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in made)
    assert got == sorted(repr((d, *brute(d, t))) for d, t in rows)
    assert sorted(repr((r.doc_id, r.restored)) for r in made) == sorted(repr((d, t or "")) for d, t in rows)


def test_empty_table(spark, documents):
    assert fill_middle.restored(fill_middle.transformed(documents([(1, "x")]).limit(0))).count() == 0


def test_query_equals_brute_force(spark):
    want = sorted((d, *brute(d, t)) for d, t in ((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    got = QUERIES["op12_fill_middle"](spark, SF).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars) for r in got] == [w[:5] for w in want]
    assert [r.output_sha256 for r in got] == [hashlib.sha256(w[5].encode()).hexdigest() for w in want]
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", [None, r"\w+", r"\S+\s*", "ab?"])
@given(text=st.text(alphabet="ab <>PSM\né", max_size=200), ranks=st.tuples(st.integers(0, 1 << 32), st.integers(0, 1 << 32)), order=st.integers(0, 99))
@settings(max_examples=150, deadline=None)
def test_round_trip(unit, text, ranks, order):
    pattern = None if unit is None else re.compile(unit)
    made = fill_middle.transform(text, Draw(*ranks, 0, order), pattern)
    assert fill_middle.restore(made.output, made.form) == text
    if made.form != "plain":
        assert len(made.output) == len(text) + 9
        ends = [0, *fill_middle._ends(text, pattern)] if pattern else list(range(len(text) + 1))
        assert made.units == len(ends) - 1
        assert {made.prefix, made.prefix + made.middle} <= set(ends)


@given(text=st.text(alphabet="ab \n", max_size=120), rank=st.integers(-1, 130), size=st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_split_keeps_counts(text, rank, size):
    for unit in (None, re.compile(r"\S+\s*")):
        tree = fill_middle.rope(text, unit, size)
        a, b = fill_middle.split(tree, rank, unit)
        assert fill_middle.text_of(a) + fill_middle.text_of(b) == text
        assert (a.chars, b.chars) == (len(fill_middle.text_of(a)), len(fill_middle.text_of(b)))
        assert a.units + b.units == tree.units and a.units == min(max(rank, 0), tree.units)


def test_depth_grows_with_the_logarithm():
    def depth(t):
        return 1 if t.text is not None else 1 + max(depth(t.left), depth(t.right))

    tree = fill_middle.rope("x" * 1_000_000, size=10)
    assert depth(tree) <= 18
    assert all(depth(part) <= 36 for part in fill_middle.split(tree, 333_333))
