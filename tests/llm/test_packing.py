import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kartospark.llm import packing
from kartospark.llm.packing import Range
from kartospark.llm.queries import QUERIES
from llm_cases import EDGE

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def brute_pieces(text, capacity):
    ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
    pieces = []
    while ids:
        pieces.insert(0, ids[-capacity:])
        ids = ids[:-capacity]
    return pieces


def falling_best_fit(sizes, capacity):
    """Sequences that one pass by falling size opens."""
    gaps, opened = Counter(), 0
    for s in sorted(sizes, reverse=True):
        c = min((c for c, n in gaps.items() if n and c >= s), default=None)
        if c is None:
            opened += 1
            c = capacity
        else:
            gaps[c] -= 1
        gaps[c - s] += 1
    return opened


def checked(rows, docs, capacity):
    """Every piece of every document once, with its ids; sequences gapless and not too long. Returns their number."""
    want = Counter()
    for doc_id, text in docs:
        start = 0
        for i, ids in enumerate(brute_pieces(text, capacity)):
            want[doc_id, i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
            start += len(ids)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_edge_rows(spark, documents, capacity):
    rows = EDGE + [(20, "a<|endoftext|>b"), (21, "x" * 40_000), (22, " " * 3000), (23, "same"), (24, "same"), (25, "same"), (26, "déjà \U0001f600 x\u0085y")]
    found = packing.packed(documents(rows), PATH, capacity).collect()
    n = checked(found, rows, capacity)
    sizes = [len(p) for _, t in rows for p in brute_pieces(t, capacity)]
    assert n <= falling_best_fit(sizes, capacity) + 1


def test_empty_table(spark, documents):
    assert packing.packed(documents([(1, "x")]).limit(0), PATH).count() == 0


def test_query_packs_as_tight_as_one_pass(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = checked(QUERIES["op13_best_fit_packing"](spark, SF).collect(), docs, 2048)
    sizes = [len(p) for _, t in docs for p in brute_pieces(t, 2048)]
    assert -(-sum(sizes) // 2048) <= n <= falling_best_fit(sizes, 2048)


@pytest.mark.parametrize("kind", ["uniform", "one_size", "small", "large", "thirds", "hot"])
def test_many_sizes(spark, kind):
    rng = np.random.default_rng(5)
    n = 6000
    sizes = {
        "uniform": rng.integers(1, 2049, n), "one_size": np.full(n, 700), "small": rng.integers(1, 9, n), "large": rng.integers(1000, 2049, n),
        "thirds": rng.integers(500, 700, n), "hot": np.where(rng.random(n) < 0.4, 37, rng.integers(1, 2049, n)),
    }[kind].tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, size int").repartition(5)
    held = defaultdict(list)
    found = packing.best_fit(items, 2048).collect()
    assert sorted(r.uid for r in found) == list(range(n))
    for r in found:
        held[r.seq].append((r.offset, sizes[r.uid]))
    for parts in held.values():
        parts.sort()
        ends = np.cumsum([x for _, x in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(held) <= 1.005 * falling_best_fit(sizes, 2048) + 1


def test_sequences_hold_the_ids(spark, documents):
    rows = EDGE + [(30 + i, "some words " * i) for i in range(60)]
    made = packing.sequences(documents(rows), PATH, 64).collect()
    assert max(len(r.ids) for r in made) <= 64
    got = Counter((p.doc_id, p.piece, tuple(r.ids[p.offset : p.offset + p.length])) for r in made for p in r.pieces)
    assert got == Counter((d, i, tuple(p)) for d, t in rows for i, p in enumerate(brute_pieces(t, 64)))


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_tokenizers(text):
    assert packing.encoded(text, PATH).tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 0]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=12), st.data())
@settings(max_examples=200, deadline=None)
def test_stretches_pair_ranks_once_and_fit(counts, data):
    """Random ranges by falling size: no gap or document is dealt twice, all that may meet do."""
    top, ranges = 1000, []
    for i, (waiting, offered) in enumerate(counts):
        low = data.draw(st.integers(1, top))
        ranges.append(Range(i, waiting, top if waiting else None, low if waiting else None, offered, low if offered else None))
        top = low
    free = {r.part: r.offered for r in ranges}
    for p in packing.stretches(ranges):
        assert p.gap_part < p.part and p.per >= 1
        assert ranges[p.gap_part].least_gap >= p.per * ranges[p.part].largest
        assert 0 < p.high - p.low <= p.per * (p.gap_high - p.gap_low)
        assert p.gap_low == ranges[p.gap_part].offered - free[p.gap_part]
        free[p.gap_part] -= p.gap_high - p.gap_low
        assert free[p.gap_part] >= 0
