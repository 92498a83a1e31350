"""Sharding by fixed virtual slots.

Records hash into ``n_slots`` virtual slots, which never change. A slot-to-shard map, a
small versioned table (``n_slots`` rows a version, whatever the data's size), begins as
round robin. Bytes are summed per slot, and rebalancing appends a version of the map that
moves slots from full shards to empty ones, as few as it can; the same edit serves new
data and a changed number of shards. So records move only with their slot.

A record's slot comes from its id, size, checksum and, where records repeat, the copy's
number, so repeats of one record, however many, spread over all slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kartospark.llm.common import plain_names, repeated, written

#: Virtual slots; also the most rows that a version of the map has.
N_SLOTS = 4096

MAP_SCHEMA = "version int, vslot int, shard int, slot_bytes long"


def _key(docs: DataFrame, id_col: str, text_col: str):
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))


def _slot(key: list[Column], n_slots: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def _numbered(counted: DataFrame, n_slots: int) -> DataFrame:
    return repeated(counted).withColumn("vslot", _slot([F.col(c) for c in ("doc_id", "size", "text_crc32", "copy")], n_slots))


def records(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, copy, vslot)`` for every row; equal rows are counted before they are shuffled."""
    return _numbered(_key(docs, id_col, text_col).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), n_slots)


def slot_sizes(spark: SparkSession, recs: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes per slot; ``n_slots`` numbers at most reach the driver."""
    found = dict(recs.groupBy("vslot").agg(F.sum("size")).collect())
    return [found.get(i, 0) for i in range(n_slots)]


def first_map(n_slots: int, n_shards: int) -> list[int]:
    """The shard of each slot before any sizes are known."""
    return [i % n_shards for i in range(n_slots)]


def edited_map(shards: list[int], sizes: list[int], n_shards: int) -> list[int]:
    """A map for ``n_shards`` that moves few slots.

    Slots of shards that no longer exist move; then shards above the mean give slots,
    largest that fits first, to the emptiest shard, while that brings both nearer the mean.
    """
    new = list(shards)
    load = [0] * n_shards
    slots: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, s in enumerate(new):
        if s < n_shards:
            load[s] += sizes[slot]
            slots[s].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda i: (-sizes[i], i)):
        s = min(range(n_shards), key=lambda x: (load[x], x))
        new[slot] = s
        load[s] += sizes[slot]
        slots[s].append(slot)
    # The fullest shard that still has a slot to give; one without is done.
    giving = set(range(n_shards))
    while len(giving) > 1:
        full, empty = max(giving, key=lambda x: (load[x], -x)), min(range(n_shards), key=lambda x: (load[x], x))
        room = (load[full] - load[empty]) // 2
        fits = [i for i in slots[full] if 0 < sizes[i] <= room]
        if not fits:
            giving.remove(full)
            continue
        slot = max(fits, key=lambda i: (sizes[i], -i))
        slots[full].remove(slot)
        slots[empty].append(slot)
        new[slot] = empty
        load[full] -= sizes[slot]
        load[empty] += sizes[slot]
    return new


def map_table(spark: SparkSession, shards: list[int], sizes: list[int], version: int = 0) -> DataFrame:
    return spark.createDataFrame([(version, i, s, b) for i, (s, b) in enumerate(zip(shards, sizes, strict=True))], MAP_SCHEMA)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the stored map."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the latest."""
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.where(F.col("version") == version).selectExpr("version", "vslot", "shard", "slot_bytes")


def placed(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    A place is the number of records in the shard's earlier virtual slots plus the rank
    within the own one, so no shard is ever sorted as a whole.
    """
    counts = recs.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"))
    there = slot_map.select("vslot", "shard", "version").join(counts, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = there.select("vslot", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "copy")
    ranked = recs.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(offsets), "vslot").withColumn("slot", (F.col("offset") + F.col("rank")).cast("long")).drop("offset", "rank")


def balanced(spark: SparkSession, sizes: list[int], n_shards: int, map_path: str | None = None) -> DataFrame:
    """The latest map for ``n_shards``: a stored one, or round robin at first, edited for ``sizes``.

    With ``map_path`` both the first version and the edited one are appended there, and
    the latest is read back.
    """
    stored = map_path is not None and _exists(spark, map_path)
    if stored:
        rows = load_map(spark, map_path).orderBy("vslot").collect()
        version, shards = rows[0]["version"], [r["shard"] for r in rows]
    else:
        version, shards = 0, first_map(len(sizes), n_shards)
        if map_path:
            save_map(map_table(spark, shards, sizes, 0), map_path)
    edited = map_table(spark, edited_map(shards, sizes, n_shards), sizes, version + 1)
    if not map_path:
        return edited
    save_map(edited, map_path)
    return load_map(spark, map_path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shard(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Shard and place of every row of ``docs``: ``doc_id, size, text_crc32, copy, vslot, shard, version, slot``.

    Shards have near equal bytes (of text, plus one a row). With ``map_path`` the map is
    kept there: a run edits the latest version found, or round robin, and appends its
    own. Null ids and texts are values like any other (a null text has size 1); repeated
    rows are all placed, each on its own. One text longer than a mean shard makes its
    shard that much larger. An empty table gives an empty result. Other columns are not
    read.
    """
    recs = written(records(docs, n_slots, id_col, text_col))
    return placed(recs, balanced(docs.sparkSession, slot_sizes(docs.sparkSession, recs, n_slots), n_shards, map_path))


def with_shards(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """``docs`` with a column ``shard``, the last: that of ``shard``, repeats numbered and dealt out as there.

    The rows are written first, with the partition that they are of: repeats are counted
    in each partition, and a copy's number is its place there behind those of earlier
    partitions. So no task holds more of a row's repeats than one partition has, and
    sizes and places agree. A column ``shard`` of ``docs`` is replaced; other names never
    clash.
    """
    spark = docs.sparkSession
    plain, (id_col, text_col) = plain_names(docs, id_col, text_col)
    text = F.col(text_col).cast("string")
    key = ["none", "i", "size", "crc"]
    doc_id = F.col(id_col).cast("long")
    columns = {"none": doc_id.isNull(), "i": F.coalesce(doc_id, F.lit(0)), "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), "crc": F.crc32(F.coalesce(text, F.lit("")).cast("binary")), "part": F.spark_partition_id()}
    rows = written(plain.withColumns(columns))
    counts = rows.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("ahead"))
    own = F.when(~F.col("none"), F.col("i"))
    sizes = slot_sizes(spark, _numbered(counts.groupBy(own.alias("doc_id"), "size", F.col("crc").alias("text_crc32")).agg(F.sum("ahead").alias("n")), n_slots), n_slots)
    slot_map = balanced(spark, sizes, n_shards, map_path).select(F.col("vslot").alias("v"), F.col("shard").alias("s"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("ahead", F.coalesce(F.sum("ahead").over(earlier), F.lit(0))).where(F.col("ahead") > 0)
    # The keys are never null, so that the join needs no other partitioning than the window: the rows are shuffled once.
    placed_ = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key, "part").orderBy("part")) - 1)
    met = placed_.join(before, [*key, "part"], "left")
    dealt = met.withColumn("slot", _slot([own, F.col("size"), F.col("crc"), (F.col("copy") + F.coalesce("ahead", F.lit(0))).cast("long")], n_slots))
    rest = {n: c for n, c in zip(plain.columns, docs.columns, strict=True) if c.lower() != "shard"}
    return dealt.join(F.broadcast(slot_map), F.col("slot") == F.col("v")).select(*rest, "s").toDF(*rest.values(), "shard")
