import re
import zlib
from collections import Counter

import pytest

from kartospark.llm import spelling
from kartospark.llm.queries import QUERIES
from llm_cases import EDGE

SF = "/root/testdata/sf0.001"


def brute_words(docs, slip):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, slip):
    n = brute_words(docs, slip)
    form, out = {}, {}
    for w in n:
        others = [v for v in n if v != w and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(others)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def rows_of(found):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect())


CASES = [
    (30, "letter " * 400 + "lettre " * 60 + "leter " * 70 + "letters " * 15 + "letterx " * 3),
    (31, "abbbbbc " * 50 + "abbbbc " * 9 + "abbbbbbc " * 9 + "aabbbbc " * 8),
    (32, "stream master tamers remast " * 6),
    (33, "Übergröße übergröße " * 9 + "Übergrösse " * 20 + "ÜBERGRÖßE " * 5),
    (34, "gleich×ung gleichung " * 7 + "gleichungen " * 7),
    (None, "letter letter lettor " * 6),
    (35, "ties00ties tiesaa tiesab tiesac " * 30 + "tiesad " * 5),
    (36, "chains " * 1000 + "chainss " * 150 + "chainsst " * 25 + "chainsstt " * 5),
    (37, "x" * 100_000 + " " + ("y" * 20_000 + " ") * 6 + ("y" * 20_001 + " ") * 40),
]


@pytest.mark.parametrize("slip", [None, 3, 199])
@pytest.mark.parametrize("hot", [10_000, 2])
def test_variants_equal_brute_force(spark, documents, slip, hot, monkeypatch):
    monkeypatch.setattr(spelling, "HOT_KEY", hot)
    docs = EDGE + CASES
    assert rows_of(spelling.variants(documents(docs), slip)) == brute([(d, t) for d, t in docs], slip)


def test_chain_of_forms_ends_at_its_root(spark, documents):
    got = {r.word: r for r in spelling.variants(documents(CASES)).collect()}
    assert got["chainsstt"].form == "chainsst" and got["chainsstt"].root == "chains"
    assert got["master"].n_near == 0  # anagrams share a key, not an order


def test_empty_tables(spark, documents):
    assert spelling.variants(documents([(1, "letter " * 9)]).limit(0)).count() == 0
    assert spelling.variants(documents([(1, None), (2, ""), (3, "short")])).count() == 0


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, 199)
    assert rows_of(QUERIES["op11_spelling_variants"](spark, SF)) == want
    assert any(form for _, form, *_ in want)
