import math
import tracemalloc
import zlib
from collections import Counter
from functools import partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kartospark.llm import language, lm, quality_model, quality_rules, queries
from kartospark.llm.common import crc32_mod
from llm_cases import EDGE

SMALL = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = queries.op8_language_spans(spark, SMALL).where("held_out").join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_scripts_and_spans(spark, documents):
    train = [(i, t, lang, None, 0) for i, (t, lang) in enumerate([("the cat and the dog went there", "en"), ("кошка и собака идут туда", "ru"), ("der Hund und die Katze gehen", "de")] * 20)]
    model = language.train(documents(train))
    rows = [(21, "кошка идут the cat and the dog went there and there"), (22, "123 !!"), (23, None), (24, "собака"), (25, "— «» …"), *EDGE]
    got = {r.doc_id: r for r in language.identify(documents(rows), model).collect()}
    assert got[21].lang_pred == "en" and [(s.lang, s.start, s.end) for s in got[21].lang_spans] == [("ru", 0, 2), ("en", 2, 11)]
    assert [got[i].lang_pred for i in (22, 23, 24, 25, 1, 2, 3)] == ["und", "und", "ru", "und", "und", "und", "und"]


def test_mixed_texts_are_in_the_language_of_most_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null and length(text) > 600")
    model = language.train(docs)
    some = {r.lang: r.text for r in docs.where("doc_id % 3 = 1").collect()}
    for a, b in [("en", "de"), ("de", "es"), ("fr", "en"), ("es", "fr")]:
        # Opens and ends in b, but has twice as many words of a.
        x, y = (some[k].split()[:60] for k in (a, b))
        text = " ".join(y[:15] + x[:60] + y[15:30])
        (got,) = language.identify(spark.createDataFrame([(text,)], "text string"), model).collect()
        spans = [s for s in got.lang_spans if s.end - s.start > 5]
        assert got.lang_pred == a and spans[0].lang == spans[-1].lang == b


def test_texts_of_no_learnt_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null")
    model = language.train(docs)
    rng = np.random.default_rng(11)
    letters = [" ".join("".join(chr(97 + int(k)) for k in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(40)) for _ in range(20)]
    strange = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw"]
    df = spark.createDataFrame([(t,) for t in letters + strange], "text string")
    assert language.kept(df, model).count() == 0
    clean = docs.where("length(text) > 200")
    assert language.kept(clean, model).count() == clean.count()


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 5, 1])
    scores = rng.normal(0, 3, (9, 3)).astype(np.float32)
    starts = np.cumsum(counts) - counts
    label = language.viterbi(scores, starts, counts, 2.0)

    def total(path, s):
        return sum(s[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for a, n in zip(starts, counts, strict=True):
        if n:
            best = max(total([k // 3**i % 3 for i in range(n)], scores[a : a + n]) for k in range(3**n))
            assert total(label[a : a + n].tolist(), scores[a : a + n]) == pytest.approx(best, abs=1e-4)


def test_new_words_take_bounded_memory(monkeypatch):
    """Scratch arrays hold the n-grams of a part of a slice's words, not of all; results are those of all at once."""
    rng = np.random.default_rng(5)
    many = [bytes(w).decode() for w in rng.integers(97, 123, (150_000, 8), dtype=np.uint8)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(many[i : i + 50]) for i in range(0, len(many), 50)], "lang": ["a", "b"] * 1500})
    score = np.log(rng.random((language.N_BUCKETS, 2))).astype(np.float32)
    model = SimpleNamespace(value=language.Model(["a", "b"], score, np.ones((len(language.SCRIPT_NAMES), 2), dtype=bool)))
    peaks, results = [], []
    for make in (language._count_batches, partial(language._label_batches, model=model, switch=10.0, spans=True, text="text", names=list(language.ADDED))):
        tracemalloc.start()
        results.append(list(make(iter([batch]))))
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
        monkeypatch.setattr(language, "parts", lambda distinct: [slice(0, len(distinct))])
        assert results[-1] == list(make(iter([batch])))
        monkeypatch.undo()
    assert max(peaks) < 90, peaks


def test_texts_are_sent_to_the_workers_once(spark, documents):
    docs = documents([(1, "the cat"), (2, None)], extra=False)
    model = language.train(docs)
    for found in (language.identify(docs, model), language.identify(docs, model, text_col="TEXT")):
        (python,) = [p for p in found._jdf.queryExecution().analyzed().toString().splitlines() if "MapInArrow" in p]
        assert "Project" not in found._jdf.queryExecution().analyzed().toString(), python
        assert found.columns == docs.columns + list(language.ADDED) and found.where("text = 'the cat'").count() == 1
    # Other types, and a text that a new column replaces, still go as a copy of their own.
    number = docs.selectExpr("doc_id", "doc_id as text")
    assert [r.text for r in language.identify(number, model).orderBy("doc_id").collect()] == [1, 2]
    named = language.identify(docs.select("doc_id", "text"), model, names=["text", "score", "spans", "fit"])
    assert named.columns == ["doc_id", "text", "score", "spans", "fit"] and {r.text for r in named.collect()} == {"und"}


def test_no_languages_and_empty_tables(spark, documents):
    model = language.train(documents([]))
    assert {r.lang_pred for r in language.identify(documents(EDGE), model).collect()} == {"und"}
    assert language.identify(documents([]), model).collect() == []


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = queries.op5_pu_quality(spark, SMALL).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99


def brute_risk(w, x, positive, prior):
    g = x @ w
    loss = lambda z: ((1 - z) ** 2 / 4).mean()
    return prior * loss(g[positive]) + max(0.0, loss(-g) - prior * loss(-g[positive]))


def labelled_rows(n=4000):
    rng = np.random.default_rng(1)
    x = np.zeros((n, quality_model.N_FEATURES))
    x[:, 0] = 1
    junk = rng.random(n) < 0.3
    x[junk, 1] = rng.uniform(0.5, 1, junk.sum())
    x[:, 20:30] = rng.random((n, 10)) * np.where(junk, 0.5, 1)[:, None]
    return x, junk, ~junk & (rng.random(n) < 0.3)


def test_risk_equals_brute_force():
    x, _, positive = labelled_rows(300)
    m_u, m_p = x.T @ x / len(x), x[positive].T @ x[positive] / positive.sum()
    rng, signs = np.random.default_rng(2), set()
    for size in (0.1, 0.5, 1.0):
        for _ in range(10):
            w = rng.normal(0, size, x.shape[1])
            value, grad = quality_model.risk(w, m_u, m_p, m_u[0], m_p[0], 0.7)
            assert value == pytest.approx(brute_risk(w, x, positive, 0.7))
            g = x @ w
            loss_n = ((1 + g) ** 2 / 4).mean() - 0.7 * ((1 + g[positive]) ** 2 / 4).mean()
            signs.add(loss_n >= 0)
            # Below zero the step goes up the negative part.
            part = (lambda v: brute_risk(v, x, positive, 0.7)) if loss_n >= 0 else (lambda v: -(((1 + x @ v) ** 2 / 4).mean() - 0.7 * ((1 + (x @ v)[positive]) ** 2 / 4).mean()))
            for k in rng.choice(x.shape[1], 5):
                e = np.zeros(len(w))
                e[k] = 1e-4
                assert grad[k] == pytest.approx((part(w + e) - part(w - e)) / 2e-4, abs=1e-4)
    assert True in signs


def test_nonnegative_risk_is_minimised():
    x, junk, positive = labelled_rows()
    w = quality_model.minimise(np.stack([x.T @ x, x[positive].T @ x[positive]]), 0.7)
    assert ((x @ w > 0) == ~junk).mean() > 0.99
    rng, least = np.random.default_rng(3), brute_risk(w, x, positive, 0.7)
    shape = np.arange(len(w)) < len(quality_model.SHAPE)  # hardly penalised, so the plain risk is least here
    assert all(brute_risk(w + shape * rng.normal(0, 0.05, len(w)), x, positive, 0.7) > least - 1e-3 for _ in range(20))


def test_words_alone_tell_texts_apart(spark, documents):
    """Texts of one shape that differ in their words only: unlabelled ones like the trusted are ranked above the others."""
    rng = np.random.default_rng(9)
    kinds = [[f"{a}{b}rtil" for a in "bcdfg" for b in "ae"], [f"{a}{b}rtil" for a in "klmnp" for b in "ou"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 30))) for i in range(1200)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 600, 2)], "doc_id long")
    score = {r.doc_id: r.score for r in quality_model.scored(documents(rows), trusted).collect()}
    good, bad = [score[i] for i in range(600, 1200, 2)], [score[i] for i in range(601, 1200, 2)]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.99


def test_quality_query_equals_brute_force(spark, documents):
    """Features, moments, prior, descent and scores of a small table, all recomputed without Spark."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(k)}" for k in rng.integers(0, 50, 40)) if i % 3 else "$$ ## !! BUY NOW " * 8 for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "a b c"), (500, "")]
    trusted = {i for i in range(120) if i % 3 and i % 2}
    got = quality_model.scored(documents(rows), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()

    def own(text):
        x = quality_model.shape(quality_rules.Text((text or "").encode()))
        n, share = (text or "").lower().split(), [0.0] * quality_model.N_LEXICAL
        for w in n:
            share[zlib.crc32(w.encode()) % quality_model.N_LEXICAL] += 1 / len(n)
        return [*x, *(math.sqrt(v) for v in share)]

    x = np.array([own(t) for _, t in rows], dtype=np.float32).astype(float)
    positive = np.array([d in trusted for d, _ in rows])
    sums = np.stack([x.T @ x, x[positive].T @ x[positive]])
    naive = quality_model.naive_weights(sums)
    g, most = x @ naive, np.abs(naive).sum()
    cuts = [np.floor((v + most) / (2 * most) * quality_model.BINS) for v in g]
    ratios = [np.mean([c >= t for c in cuts]) / np.mean([c >= t for c, p in zip(cuts, positive, strict=True) if p]) for t in set(cuts) if np.mean([c >= t for c, p in zip(cuts, positive, strict=True) if p]) >= 0.2]
    prior = min(0.95, max(0.05, min(ratios)))
    w = quality_model.minimise(sums, prior)
    want = [min(1.0, max(0.0, (v + 1) / 2)) for v in x @ w]
    told = sorted((repr(r.doc_id), r.score) for r in got)
    for (a, s), (b, v) in zip(told, sorted((repr(d), v) for (d, _), v in zip(rows, want, strict=True)), strict=True):
        assert a == b and s == pytest.approx(v, abs=1e-3)


def test_quality_edge_cases(spark, documents):
    trusted = spark.createDataFrame([(5,), (6,), (None,)], "doc_id long")
    got = quality_model.scored(documents(EDGE), trusted).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    none = quality_model.scored(documents(EDGE), trusted.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.scored(documents([]), trusted).collect() == []


def brute_base(rows, held_out):
    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    counts = Counter(w for d, t in rows if d is not None and not held_out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sorted((repr(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for d, t in rows)


def test_unigram_scores_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "N_FREQUENT", 40)  # most words go through the join
    monkeypatch.setattr(lm, "N_MODELLED", 16)
    rng = np.random.default_rng(2)
    rows = EDGE + [(100 + i, " ".join(f"w{int(k)}" for k in rng.zipf(1.4, 50) % 300)) for i in range(60)]
    got = lm.scored(documents(rows), crc32_mod("doc_id", 10) != 0).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == brute_base(rows, lambda d: zlib.crc32(str(d).encode()) % 10 == 0)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_words_equal_python_words():
    texts = [None, "", " \t ", "one", " A\u00c9 b\x1cc\n\n d\x0b\x0ce ", "x  y", "Zw\u00f6lf \u00a0 words", "one x"]
    counts, number, distinct = lm.words(pa.array(texts, type=pa.string()))
    got, at = [distinct[i] for i in number], 0
    for text, n in zip(texts, counts, strict=True):
        assert got[at : at + n] == (text or "").encode().lower().split()
        at += n


def test_recurrent_model_is_a_distribution(spark, documents):
    """Probabilities of all next tokens add up to one: modelled words, the end, words of open classes and unseen ones."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.5, 30) % 40)) for i in range(40)]
    df = documents(rows).select("doc_id", "text")
    counts = lm.count(df)
    lex = lm.lexicon(counts, 40)
    params = lm.train(df, lex, 40, spark.sparkContext.broadcast(lex), 4000)
    shape = lex.shape
    h = rng.normal(size=(1, lm.gru.HIDDEN)).astype(np.float32)
    words = np.arange(shape.n_words)
    cls = np.searchsorted(shape.starts, words, side="right") - 1
    closed = np.exp(lm.gru.log_prob(params, shape, np.repeat(h, len(words), 0), cls, words)).sum()
    opened = np.exp(lm.gru.log_prob(params, shape, np.repeat(h, shape.n_open, 0), shape.n_closed + np.arange(shape.n_open), np.full(shape.n_open, -1))).sum()
    assert closed + opened == pytest.approx(1, abs=1e-4)


def test_training_does_not_depend_on_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "_SLICE", 300)
    rng = np.random.default_rng(5)
    df = documents(EDGE + [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.5, 30) % 40)) for i in range(60)]).select("doc_id", "text")
    lex = lm.lexicon(lm.count(df), 70)
    sent = spark.sparkContext.broadcast(lex)
    one, many = (lm.gru.pack(lm.train(d, lex, 70, sent, 8000, group_bytes=500)) for d in (df.coalesce(1), df.repartition(7)))
    assert np.abs(one - many).max() < 1e-5
    assert np.abs(one - lm.gru.pack(lm.start_weights(lex, 70))).max() > 0.01


def test_every_training_text_trains_once(spark, documents, monkeypatch):
    """The texts that reach the trainers, over all rounds, are the table's rows."""
    rows = EDGE + [(100 + i, f"text {i}") for i in range(50)]
    df = documents(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = spark.sparkContext.accumulator(0)

    lex = lm.lexicon(lm.count(df), len(rows))
    monkeypatch.setattr(lm, "_train_batches", _counting(lm._train_batches, seen))
    lm.train(df, lex, len(rows), spark.sparkContext.broadcast(lex), 1000)
    assert seen.value == len(rows)


def _counting(batches_of, seen):
    def run(batches, **options):
        def told():
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return batches_of(told(), **options)

    return run


def test_gradients_equal_differences():
    """Backpropagated gradients of a window against central differences of its loss."""
    rng = np.random.default_rng(6)
    shape = lm.gru.Shape(np.array([0, 1, 4, 6]), 2)
    like = lm.gru.initial(shape, np.ones(5), np.ones(6))
    flat = (lm.gru.pack(like) + rng.normal(0, 0.5, sum(v.size for v in like.values()))).astype(np.float32)
    lengths = [4, 4, 4, 3, 2]
    xs = [rng.integers(0, shape.start_token + 1, k) for k in lengths]
    cls = rng.integers(0, 5, sum(lengths))
    word = np.array([rng.integers(shape.starts[c], shape.starts[c + 1]) if c < 3 else -1 for c in cls])
    h = rng.normal(0, 0.5, (4, lm.gru.HIDDEN)).astype(np.float32)

    def loss(w):
        p = lm.gru.unpack(w, like)
        return -lm.gru.log_prob(p, shape, lm.gru.Steps(p, shape, xs, h).out, cls, word).mean()

    grad = np.zeros_like(flat)
    lm.gru.window_grads(lm.gru.unpack(flat, like), shape, xs, cls, word, h, lm.gru.unpack(grad, like))
    for i in rng.choice(len(flat), 120, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 0.01
        down[i] -= 0.01
        assert grad[i] == pytest.approx((loss(up) - loss(down)) / 0.02, abs=2e-4)


def test_state_runs_through_the_whole_text():
    rng = np.random.default_rng(4)
    shape = lm.gru.Shape(np.array([0, 2, 5]), 1)
    p = lm.gru.initial(shape, np.ones(3), np.ones(5))
    p = {k: (v + rng.normal(0, 0.5, v.shape)).astype(np.float32) for k, v in p.items()}
    word = rng.integers(0, 5, 40)
    cls = np.array([0, 0, 1, 1, 1])[word]
    starts, counts = np.array([0, 10, 10, 33]), np.array([10, 0, 23, 7])
    whole = lm.gru.total_log_prob(p, shape, word, cls, word, starts, counts, n_streams=2, window=4)
    size = lm.gru.HIDDEN

    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    for a, n in zip(starts, counts, strict=True):
        h, x = np.zeros(size), shape.start_token
        for t in range(a, a + n):
            e, u = p["E"][x], h @ p["U"]
            z, r = sigmoid(e[:size] + u[:size]), sigmoid(e[size : 2 * size] + u[size : 2 * size])
            new = np.tanh(e[2 * size :] + r * u[2 * size :])
            h = (1 - z) * new + z * h
            by_class, lo, hi = np.exp(h @ p["Wc"] + p["bc"]), *shape.starts[cls[t] : cls[t] + 2]
            by_word = np.exp(h @ p["Ww"][:, lo:hi] + p["bw"][lo:hi])
            want = np.log(by_class[cls[t]] / by_class.sum() * by_word[word[t] - lo] / by_word.sum())
            assert whole[t] == pytest.approx(want, abs=1e-4)
            x = word[t]


def test_recurrent_model_beats_the_base(spark):
    got = queries.op7_gru_scores(spark, SMALL).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_model_without_training_text(spark, documents):
    got = lm.scored(documents(EDGE), F.lit(False)).collect()
    assert len(got) == len(EDGE) and all(math.isfinite(r.score) for r in got)
    assert lm.scored(documents([]), F.lit(True)).collect() == []


def test_streams_that_are_left_run_in_long_windows():
    """One long text among short ones: every row once and in its text's order, few windows for what is left."""
    counts = np.array([3, 5000, 4, 0, 2])
    starts = np.cumsum(counts) - counts
    feed = lm.gru.Feed(lm.gru.Shape(np.array([0, 1]), 1), np.zeros(counts.sum(), dtype=np.int64), starts, counts, 4)
    windows = list(feed.windows(64, 256 * 64))
    rows = np.concatenate([r for w in windows for r in w])
    assert len(windows) < 5 and sorted(rows.tolist()) == list(range(counts.sum()))
    assert all((np.diff(rows[(rows >= s) & (rows < s + n)]) == 1).all() for s, n in zip(starts, counts, strict=True))
    assert len(list(feed.windows(64))) == -(-5000 // 64)
