import random

import numpy as np
import pytest
import xxhash

from kartospark.llm import simhash
from llm_cases import EDGE, components


def fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, size, distance):
    fps = [fingerprint(t, size) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= distance]
    groups = components(len(rows), links)
    low = {}
    for (doc, _), g in zip(rows, groups, strict=True):
        if doc is not None:
            low[g] = min(low.get(g, doc), doc)
    return sorted((repr(d), f, repr(low.get(g))) for (d, _), f, g in zip(rows, fps, groups, strict=True))


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(300)] = f"w{rng.randrange(500)}"
        out.append((100 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_groups_equal_brute_force(spark, documents, block):
    rows = EDGE + near_copies(60, 1) + [(500 + i, " ".join(str(random.Random(i).random()) for _ in range(20))) for i in range(40)]
    got = simhash.near_duplicates(documents(rows), 4, 4, block=block).collect()
    assert sorted((repr(r.doc_id), r.fp & (2**64 - 1), repr(r.component_id)) for r in got) == brute(rows, 4, 4)


def test_wider_distance(spark, documents):
    rows = near_copies(40, 2)
    got = simhash.near_duplicates(documents(rows), 4, 7).collect()
    assert sorted((repr(r.doc_id), r.fp & (2**64 - 1), repr(r.component_id)) for r in got) == brute(rows, 4, 7)


def test_fingerprint_of_spark_hash(spark):
    from pyspark.sql import functions as F

    text = "Ein Wort é"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_long_runs_are_searched_breadth_first():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 62, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 62, 300, dtype=np.uint64)))
    a, b = simhash._links_of(fps, np.array([0, len(fps)]), 4)
    assert len(a) == len(fps) - 1
    assert (np.bitwise_count(a ^ b) <= 4).all()


def test_one_of_each_keeps_clean_documents(spark, documents):
    clean = [(900 + i, " ".join(str(random.Random(-i - 1).random()) for _ in range(30))) for i in range(30)]
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    copies = []
    for i in range(20):
        words = list(base)
        words[rng.randrange(400)] = "changed"
        copies.append((10 + i, " ".join(words)))
    df = documents(clean + copies + [(10, " ".join(base)), (950, None), (951, "")])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == sorted([10, 950] + [d for d, _ in clean]) or ids == sorted([10, 950, 951] + [d for d, _ in clean])


def test_empty_table(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.one_of_each(documents([])).collect() == []
