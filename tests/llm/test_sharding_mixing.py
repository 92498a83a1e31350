import zlib
from collections import Counter, defaultdict

import pytest

from kartospark.llm import mixing, queries, sharding
from llm_cases import EDGE


def many(n):
    return EDGE + [(1000 + i, f"text number {i} " + "word " * (i % 40)) for i in range(n)] + [(77, "a repeated row")] * n


def test_every_row_has_one_gapless_place(spark, documents):
    rows = many(300)
    got = sharding.shard(documents(rows), 4, 64).collect()
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert sizes == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    places = defaultdict(list)
    load = Counter()
    for r in got:
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    rest = [load[s] for s in range(4)]
    assert sorted(rest)[2] - sorted(rest)[0] < 200  # one shard has the long text


def test_map_is_stored_by_version_and_edited(spark, documents, tmp_path):
    path = str(tmp_path / "map")
    rows = many(400)[len(EDGE) :]
    sizes = sharding.slot_sizes(spark, sharding.records(documents(rows), 256), 256)
    got = sharding.shard(documents(rows), 8, 256, map_path=path).collect()
    first, edited = ([r.shard for r in sharding.load_map(spark, path, v).orderBy("vslot").collect()] for v in (0, 1))
    assert first == sharding.first_map(256, 8) and edited == sharding.edited_map(first, sizes, 8)
    assert {r.version for r in got} == {1} and all(r.shard == edited[r.vslot] for r in got)
    load = [sum(s for s, x in zip(sizes, edited, strict=True) if x == k) for k in range(8)]
    assert max(load) - min(load) <= max(sizes)
    # A ninth shard takes slots from the others, and only those records move.
    more = {(r.doc_id, r.size, r.text_crc32, r.copy): r.shard for r in sharding.shard(documents(rows), 9, 256, map_path=path).collect()}
    assert [r.version for r in sharding.load_map(spark, path).select("version").distinct().collect()] == [2]
    moved = [r for r in got if more[r.doc_id, r.size, r.text_crc32, r.copy] != r.shard]
    assert 0 < sum(r.size for r in moved) < 0.3 * sum(sizes)
    # Seven shards: slots of the two that go move.
    grown = [r.shard for r in sharding.load_map(spark, path).orderBy("vslot").collect()]
    fewer = sharding.edited_map(grown, sizes, 7)
    assert max(fewer) == 6 and sum(a != b for a, b in zip(grown, fewer, strict=True)) < 160


def test_shard_query_equals_its_law(spark):
    """The query's columns against the documents: sizes, checksums, gapless places, near equal bytes, a stored second version."""
    small = "/root/testdata/sf0.001"
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op2_slot_shards(spark, small).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len(t) + 1, zlib.crc32(t)) for d, t in docs)
    assert {(r.law, r.map_version, r.grown_shard) for r in got} == {("bytes", 1, None)}
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(load) == set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in got)
    slots = defaultdict(set)
    for r in got:
        slots[r.virtual_slot].add(r.shard)
    assert all(len(s) == 1 for s in slots.values())


@pytest.mark.parametrize("copies", [2, 1000, 1001])
def test_repeated_rows_are_dealt_out(spark, documents, copies):
    """Rows go where ``shard`` puts their records, however often they repeat and however they lie in partitions."""
    rows = [(1, "the same row")] * copies + [(None, None)] * 7 + [(2 + i, f"row {i}") for i in range(200)]
    want = Counter((r.doc_id, r.size, r.shard) for r in sharding.shard(documents(rows), 4, 256).collect())
    for parts in (1, 5):
        out = sharding.with_shards(documents(rows).repartition(parts), 4, 256).collect()
        assert Counter((r.doc_id, len((r.text or "").encode()) + 1, r.shard) for r in out) == want
    if copies > 2:
        load = Counter(r.shard for r in out)
        assert max(load.values()) < 1.3 * min(load.values())


def test_shard_column(spark, documents):
    df = documents(many(50))
    out = sharding.with_shards(df, 4)
    rest = [c for c in df.columns if c != "shard"]
    assert out.columns == [*rest, "shard"] and {r.shard for r in out.select("shard").distinct().collect()} == set(range(4))
    assert Counter(map(repr, out.select(rest).collect())) == Counter(map(repr, df.select(rest).collect()))


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target | {s: weight[s] * level for s in free}


def source_rows():
    rows = [(d, t, "en", "src0", 0) for d, t in EDGE]
    rows += [(100 + i, "w " * (i % 23), None, ["a", "b", "é", None, "src0"][i % 5 if i % 3 else 1], 0) for i in range(400)]
    return rows + [(42, "one two three", None, "b", 0)] * 300


def test_mix_meets_targets(spark, documents):
    rows = source_rows()
    got = mixing.mix(documents(rows)).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken, most = defaultdict(int), defaultdict(int)
    assert Counter((r.source, r.doc_id, r.size) for r in got) == Counter((s, d, len((t or "").split())) for d, t, _, s, _ in rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        assert r.taken >= r.size * (want[r.source] // max(1, sizes[r.source]))
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in sizes)
    again = mixing.mix(documents(rows)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_sample_follows_quality(spark, documents):
    rows = [(i, "one two three four", None, "a", 0) for i in range(2000)] + [(5000 + i, "one two three four", None, "b", 0) for i in range(500)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 0.25) for i in range(2000)], "doc_id long, weight double")
    # Both sources end at a share of their words, and of a's documents those of high quality are drawn.
    got = mixing.mix(documents(rows), (1, 3), quality).where("source = 'a'").collect()
    picked = Counter(r.doc_id % 2 for r in got if r.taken > r.size)
    assert 0 < sum(picked.values()) < len(got)
    assert picked[1] > 1.5 * picked[0]


def test_mixed_documents_repeat(spark, documents):
    rows = source_rows()
    df = documents(rows)
    taken = Counter()
    for r in mixing.mix(df).where("size > 0").collect():
        taken[r.doc_id, r.source, r.size] += r.taken // r.size
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out.collect()) == +taken


def test_texts_of_one_checksum_are_told_apart(spark, documents):
    """Two texts of equal crc32 without ids: each comes as often as it is taken, and no other in its place."""
    pairs = ("plumless", "buckeroo")
    assert len({zlib.crc32(t.encode()) for t in pairs}) == 1
    df = documents([(None, t, None, "a", 0) for t in pairs] + [(i, "one two", None, "b", 0) for i in range(20)])
    out = Counter(r.text for r in mixing.mixed(df, (1, 1)).where("source = 'a'").collect())
    assert set(out) == set(pairs)


def test_empty_tables(spark, documents):
    assert sharding.shard(documents([])).collect() == []
    assert sharding.with_shards(documents([])).collect() == []
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mixed(documents([])).collect() == []
