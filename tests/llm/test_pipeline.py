from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from kartospark.llm import decontaminate
from kartospark.llm.common import table, written
from llm_cases import EDGE, components
from test_sharding_mixing import brute_targets
from test_shingle_sets import jaccard, shingle_set

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SMALL))
        out[name] = (before, docs)
    return out


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        assert after.columns == before.columns + ["shard"] * (name == "shards")


def test_decisions_take_effect(spark, stages):
    for before, after in list(stages.values())[:3]:
        assert after.exceptAll(before).isEmpty()
    assert stages["near_dedup"][1].count() < stages["near_dedup"][0].count()
    assert stages["near_dedup"][1].select("text").distinct().count() == stages["near_dedup"][1].count()
    clean = stages["decontamination"][1]
    assert decontaminate.find_passages(clean, table(spark, SMALL, "benchmark")).where("size(hits) > 0").isEmpty()
    assert stages["shards"][1].select("shard").distinct().count() == 16


CLASHES = ("lang_pred", "lang_score", "lang_spans", "lang_pred_0", "id", "id_0", "key", "key_0", "mine_0", "text_0", "TEXT_1", "root", "class", "__id", "__key", "__k", "__text", "__n", "n_0", "rows_0", "copy_0", "s_0", "vslot", "slot_0", "size_0", "a.b", "c`d")


def quoted(name):
    return "`" + name.replace("`", "``") + "`"


def clashing(df):
    return df.selectExpr("*", *(f"concat('mine ', coalesce(cast(doc_id as string), 'x')) as `{n.replace(chr(96), chr(96) * 2)}`" for n in CLASHES if n.lower() not in [c.lower() for c in df.columns]))


def test_edge_rows_pass_every_stage(spark, documents):
    """Row sets of each stage on rows of every odd kind, with columns named as a stage might name its own; their values stay."""
    sources = ["a", None, "b"]
    rows = [(d, t, None, sources[i % 3], 0) for i, (d, t) in enumerate(EDGE)] + [(20 + i, f"plain words of text number {i} that go on for a while", "en", "a", 0) for i in range(6)]
    docs = clashing(documents(rows))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SMALL))
        kept = columns if name != "shards" else [c for c in columns if c != "shard"]
        assert docs.columns == kept + ["shard"] * (name == "shards"), name
        old, new = (Counter(map(repr, df.select([quoted(c) for c in kept]).collect())) for df in (before, docs))
        assert set(new) <= set(old), name
        if name in ("language_id", "decontamination"):
            assert all(new[r] == old[r] for r in new), name
        seen[name] = docs.select("doc_id", "text").collect()
    letterless = {None, "", " \t\n "}
    assert Counter((r.doc_id, r.text) for r in seen["language_id"]) == Counter((d, t) for d, t, *_ in rows if t not in letterless)
    assert Counter(r.doc_id for r in seen["near_dedup"])[5] == 1 and 6 not in {r.doc_id for r in seen["near_dedup"] if r.text.startswith("the same")}
    assert sum(r.doc_id == 4 for r in seen["near_dedup"]) == 1
    assert len(seen["decontamination"]) == len(seen["near_dedup"]) and len(seen["shards"]) == len(seen["source_mix"]) > 0


def test_empty_tables_pass_every_stage(spark, documents):
    docs = clashing(documents([]))
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL))
    assert docs.collect() == []


def test_pipeline_equals_its_parts(spark):
    """What run() returns, against brute force: near copies by exact shingle sets, passages by windows, targets by words."""
    docs = table(spark, SMALL, "documents").collect()
    kept = [r for r in docs if r.text and any(c.isalpha() for c in r.text)]
    sets = [shingle_set(r.text) for r in kept]
    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_shingle[g].append(i)
    pairs = {(i, j) for at in by_shingle.values() for i in at for j in at if i < j}
    group = components(len(kept), [(i, j) for i, j in pairs if jaccard(sets[i], sets[j]) >= 0.8])
    first = {}
    for i in sorted(range(len(kept)), key=lambda i: kept[i].doc_id):
        first.setdefault(group[i], i)
    windows = set()
    for r in table(spark, SMALL, "benchmark").collect():
        w = decontaminate.words((r.text or "").encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = []
    for i in first.values():
        w = decontaminate.words(kept[i].text.encode())
        if not any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1)):
            clean.append(kept[i])
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in clean}
    total = defaultdict(int)
    for r in clean:
        total[r.source] += len(r.text.split())
    want = brute_targets(dict(total))
    taken, times = defaultdict(int), Counter(r.doc_id for r in got)
    for r in got:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 20_000 for s in want)
    assert max(times.values()) <= 2
    for r in clean:
        assert times[r.doc_id] >= want[r.source] // total[r.source] or not r.text.split()
