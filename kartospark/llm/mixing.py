"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget of words by weight, none beyond a cap of times its size. A
source's target is filled by complete epochs first; the rest is a weighted sample
without replacement: every document draws an exponential key with its quality weight as
rate, and documents are taken in key order while their prefix sum of words stays within
the rest.

The prefix sum never sorts a source as a whole. Keys fall into ``N_BUCKETS`` ranges,
whose sums (a few rows a source) show which one range the budget ends in; documents of
earlier ranges are taken, of later ones not, and only that one range is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartospark.llm.common import WORD, repeated, unused, written

#: Weights of the sources by rank, repeating.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
N_BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Tells texts apart, in 64 bits; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sampling_key(id_text: Column, weight: Column) -> Column:
    """Exponential key with rate ``weight``: minus the logarithm of a uniform number drawn by md5 from ``id_text``."""
    uniform = (F.conv(F.substring(F.md5(id_text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target, epochs, rest)`` from ``(source, source_size)``, one row a source.

    The share of a source is the smaller of its cap and weight times a level common to
    all; sources in order of cap per weight show which are capped. Sources sort by code
    point, null last.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    capped = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    every = Window.partitionBy()
    level = (
        capped.withColumn("total", F.sum("source_size").over(every) * F.lit(budget))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("behind", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("behind") < F.col("w") * (F.col("total") - F.col("before")))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("w"))).over(every))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("total") - F.col("spent")) / F.col("sharing"))
    out = level.select("source", "source_size", target.cast("double").alias("target"))
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def _bucket() -> Column:
    return F.floor((1 - F.exp(-F.col("key"))) * (N_BUCKETS - 1)).cast("int")


def _with_plan(groups: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Join each source's target and the bucket its rest ends in to ``groups``."""
    sums = groups.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights).withColumnRenamed("source", "s")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ended = prefix.join(goal, F.col("source").eqNullSafe(F.col("s"))).groupBy("s", "source_size", "target", "epochs", "rest")
    here = F.expr("before < rest and before + words >= rest")
    plan = ended.agg(F.coalesce(F.max(F.when(here, F.col("bucket"))), F.lit(-1)).alias("end"), F.coalesce(F.max(F.when(here, F.col("before"))), F.lit(0)).alias("before"))
    return groups.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(source, doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` is the number of words the mix takes from the row, repeats counted: size
    times whole epochs, and once more if sampled. ``quality`` gives ``(doc_id, weight)``,
    one row an id; other documents weigh 1. A document at the end of the budget is
    sampled if at least half of it fits.

    Null texts have size 0 and take nothing; a null source is a source; null ids are
    documents that draw by their text alone. Repeated rows draw the same key and are
    taken one after the other. An empty table gives an empty result. Other columns are
    not read.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), n_words(text).alias("size"), text_key(text).alias("key_text"))
    groups = rows.groupBy("source", "doc_id", "size", "key_text").agg(F.count(F.lit(1)).alias("n"))
    if quality is not None:
        q = quality.select(F.col("doc_id").alias("q_id"), F.col("weight").cast("double").alias("weight"))
        groups = groups.join(q, F.col("doc_id") == F.col("q_id"), "left").drop("q_id")
    else:
        groups = groups.withColumn("weight", F.lit(None).cast("double"))
    drawn = groups.withColumn("key", sampling_key(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("key_text"))), F.coalesce("weight", F.lit(1.0))))
    groups = written(drawn.withColumn("bucket", _bucket()).drop("weight"))
    planned = _with_plan(groups, weights)
    sure = planned.where("bucket <> end").withColumn("m", F.when(F.col("bucket") < F.col("end"), F.col("n")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "key_text").rowsBetween(Window.unboundedPreceding, -1)
    last = planned.where("bucket = end").withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    fits = F.ceil((F.col("rest") - F.col("before") - F.col("size") / 2) / F.col("size"))
    last = last.withColumn("m", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(fits, F.col("n")))).otherwise(0))
    columns = ["source", "doc_id", "size", "key_text", "key", "source_size", "target", "epochs", "n", "m"]
    each = repeated(sure.select(columns).union(last.select(columns)))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("copy") < F.col("m"), 1).otherwise(0))
    return each.select("source", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "key_text", "copy")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as ``mix`` takes it, with the columns of ``docs``.

    Rows without words are in no mix; other columns go with their row, whatever their
    names. Repeated rows together appear as often as ``mix``
    takes them in all.
    """
    took = mix(docs, weights, quality, id_col, text_col, source_col).where("size > 0 and taken > 0")
    s, i, c, n, rows, copy = unused(docs, "s", "id", "key", "n", "rows", "copy")
    times = took.groupBy(F.col("source").alias(s), F.col("doc_id").alias(i), F.col("key_text").alias(c)).agg(F.sum((F.col("taken") / F.col("size")).cast("long")).alias(n), (F.max("copy") + 1).alias(rows))
    text = F.col(text_col).cast("string")
    same = F.col(source_col).cast("string").eqNullSafe(F.col(s)) & F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (text_key(text) == F.col(c))
    joined = docs.join(times, same)
    one = joined.where(F.col(rows) == 1).drop(s, i, c, rows)
    many = joined.where(F.col(rows) > 1).dropDuplicates([s, i, c]).drop(s, i, c, rows)
    return repeated(one.union(many), n, copy).drop(copy)
