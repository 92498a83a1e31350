"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are reported wherever they stand. Weak candidates (a login name, an opaque
run of characters, an endpoint address) prove nothing alone: they are reported only when
the parts that complete a credential lie within ``SCOPE`` code points: an identifier
needs a secret, a secret an identifier, an endpoint both. Parts meet by an interval
join: each part is put into the stretches of text that it touches, a candidate also into
those within reach, and rows of one stretch of one text are joined on the exact
distance. A stretch holds a handful of parts at most, so the join stays linear however
long a text is.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all``
with one pattern see the same matches, so lengths of pieces and matches add up to
offsets. All offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartospark.llm.common import written

#: Patterns of the base kinds, in order of report; the last number is the group that must have the least length.
BASE = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    # Maximal runs, so asking for the length at once finds the same as matching all runs and dropping short ones.
    "hex": (r"[0-9a-f]{24,}", 24, 0),
}
#: Weak candidates, reported after the base kinds.
WEAK = {
    "login": (r"""([uU][sS][eE][rR]([nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD])["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 3, 3),
    "opaque": (r"[A-Za-z0-9+/]{40,}", 40, 0),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9_./-]*)?", 10, 0),
}
KINDS = [*BASE, *WEAK]
IDENTIFIERS = ("access", "login")
SECRETS = ("assign", "hex", "opaque")
#: Farthest apart that two parts of one credential lie, in code points.
SCOPE = 200
#: Matches folded at a time.
RUN = 256

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def found(text: Column, kind: str) -> Column:
    """Spans ``(start, kind, end)`` of a kind's leftmost non-overlapping matches, but for those too short."""
    pattern, least, group = {**BASE, **WEAK}[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    told = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(pieces, F.char_length).alias("gap"), F.transform(whole, F.char_length).alias("size"), F.transform(told, F.char_length).alias("told"))
    parts = F.filter(parts, lambda x: x["size"].isNotNull())  # there is one more piece than matches

    # A fold copies what it has built at every step, so matches are folded in runs of ``RUN``, from where the runs before them end.
    def length(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["size"])

    def grown(ends: Column, run: Column) -> Column:
        return F.array_append(ends, F.element_at(ends, -1) + length(run))

    def spans(run: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + x["size"]).alias("end"))
            return F.struct((begin + x["size"]).alias("at"), F.when(x["told"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda acc: acc["out"])

    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(RUN)), lambda i: F.slice(parts, i, RUN))
    ends = F.aggregate(runs, F.array(F.lit(0)), grown)
    found_ = F.flatten(F.transform(runs, lambda run, i: spans(run, F.get(ends, i))))
    return F.when(text.rlike(pattern), found_).otherwise(F.array().cast(_SPANS))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    spans = rows.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64("doc_id", F.length("text"), F.lit(7)).alias("k2"), *[found(F.col("text"), k).alias(k) for k in KINDS])
    return spans.select("doc_id", "k1", "k2", F.concat(*BASE).alias("base"), F.concat(*WEAK).alias("weak"))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates among ``parts`` (``k1, k2, start, kind, end``) that complete a credential."""
    number = {k: i for i, k in enumerate(KINDS)}

    def of(kinds: tuple[str, ...]) -> Column:
        return F.col("kind").isin([number[k] for k in kinds])

    def stretches(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))

    def near(candidates: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        others = parts.where(of(kinds)).select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("start").alias("os"), F.col("end").alias("oe"), stretches(F.col("start"), F.col("end")).alias("obin"))
        reach = candidates.withColumn("bin", stretches(F.col("start") - scope, F.col("end") + scope))
        apart = (F.col("oe") <= F.col("start")) & (F.col("start") - F.col("oe") <= scope) | (F.col("os") >= F.col("end")) & (F.col("os") - F.col("end") <= scope)
        met = reach.join(others, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")) & (F.col("bin") == F.col("obin")) & apart, "left_semi")
        return met.select("k1", "k2", "start", "kind", "end").distinct()

    logins = near(parts.where(of(("login",))), SECRETS)
    opaque = near(parts.where(of(("opaque",))), IDENTIFIERS)
    endpoints = near(near(parts.where(of(("endpoint",))), SECRETS), IDENTIFIERS)
    return logins.union(opaque).union(endpoints)


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)`` for every row: spans ``(start, kind, end)`` in order, ``kind`` a number into ``KINDS``.

    ``base`` has the base kinds, ``spans`` also the linked weak candidates. A null text
    counts as empty; texts are scanned whole. Repeated rows have equal results; rows
    that share an id but not a text are told apart. An empty table gives an empty
    result. Other columns are not read.
    """
    scanned = written(_scan(docs, id_col, text_col))
    parts = scanned.where(F.size("weak") > 0).select("k1", "k2", F.inline(F.concat("base", "weak"))).distinct()
    more = linked(parts, scope).groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    joined = scanned.join(more, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    both = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(both).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
