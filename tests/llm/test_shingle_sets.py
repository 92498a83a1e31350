import random
import time

import pytest

from kartospark.llm import shingle_sets, simhash
from llm_cases import EDGE, components


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    return components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def repeated_line(pairs):
    """Pairs of documents that share one line forty times over and nothing else."""
    rng, out = random.Random(7), []
    for _ in range(pairs):
        line = " ".join(words(rng, 16)) + "\n"
        out += [line * 40 + " ".join(words(rng, 84)) for _ in range(2)]
    return out


def pair_of(rng, similarity, n):
    """Two texts of ``n`` shingles with about this similarity of sets, that differ at their ends."""
    own = round(n * (1 - similarity) / (1 + similarity))
    base = words(rng, n + 4 - own)
    return [" ".join(base + words(rng, own)) for _ in range(2)]


def isolated(low, high, pairs, seed):
    rng = random.Random(seed)
    return [t for _ in range(pairs) for t in pair_of(rng, rng.uniform(low, high), rng.choice([60, 200]))]


def groups_of(spark, documents, texts, block=4096):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.root for r in shingle_sets.similar_groups(documents(rows), block=block).collect()}
    names = [got[i] for i in range(len(rows))]
    return [names.index(x) for x in names], brute(rows)


def test_a_repeated_line_merges_nothing(spark, documents):
    df = documents([(i, t) for i, t in enumerate(repeated_line(20))])
    assert simhash.one_of_each(df).count() == 40


def test_pairs_below_the_similarity_stay(spark, documents):
    texts = isolated(0.65, 0.79, 60, 1)
    got, want = groups_of(spark, documents, texts)
    assert want == list(range(len(texts)))
    assert got == want


@pytest.mark.parametrize("block", [4096, 5])
def test_groups_equal_brute_force(spark, documents, block):
    rng = random.Random(3)
    base = words(rng, 120)
    near = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(120)] = words(rng, 1)[0]
        near.append(" ".join(copy))
    texts = [t for _, t in EDGE] + near + repeated_line(5) + isolated(0.7, 0.9, 30, 4) + ["One two", "one  TWO", "one two three"]
    got, want = groups_of(spark, documents, texts, block)
    assert got == want


def test_long_runs_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(shingle_sets, "LONG_RUN", 3)
    rng = random.Random(6)
    base = words(rng, 100)
    texts = [" ".join(base[: 100 - k] + words(rng, k)) for k in range(0, 30)]
    got, want = groups_of(spark, documents, texts)
    assert got == want


def test_what_pivot_tables_link_is_verified_first_and_left_out_of_the_join(spark, documents, monkeypatch):
    """Groups are those without the tables; near copies that the tables connect do not stay in the join's runs."""
    rng = random.Random(12)
    base = words(rng, 400)
    near = [" ".join(base[:k] + words(rng, 1) + base[k + 1 :]) for k in range(0, 60, 3)]
    texts = [t for _, t in EDGE] + near + repeated_line(5) + isolated(0.7, 0.9, 20, 8)
    df = documents([(i, t) for i, t in enumerate(texts)])
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: (lambda d: (seen.append(d.count()), d)[1])(links(*a, **k)))
    kept = simhash.one_of_each(df).count()
    assert seen[0] >= 10
    want = [brute([(i, t) for i, t in enumerate(texts)])]
    got = {r.doc_id: r.root for r in shingle_sets.similar_groups(df, near=simhash.near_runs(df)).collect()}
    names = [got[i] for i in range(len(texts))]
    assert [names.index(x) for x in names] == want[0]
    assert kept == len(set(want[0]))


def test_isolated_pairs_are_found(spark, documents):
    texts = isolated(0.8, 0.86, 60, 2)
    got, want = groups_of(spark, documents, texts)
    assert len(set(want)) < 70
    assert got == want


def test_long_chain_of_excerpts(spark, documents):
    """20 000 excerpts of one text, each like the next at 0.82 and like the one after at 0.68, are one group; a gap of three steps splits it."""
    rng = random.Random(9)
    n, step, length = 20_000, 10, 104
    text = words(rng, n * step + length)
    starts = [k * step + (30 if k >= n // 2 else 0) for k in range(n)]
    rows = [(i, " ".join(text[a : a + length])) for i, a in enumerate(starts) if a + length <= len(text)]
    began = time.monotonic()
    roots = [r.root for r in shingle_sets.similar_groups(documents(rows, extra=False)).orderBy("doc_id").collect()]
    assert time.monotonic() - began < 240
    half = n // 2
    assert len(set(roots[:half])) == 1 and len(set(roots[half:])) == 1 and roots[0] != roots[-1]
