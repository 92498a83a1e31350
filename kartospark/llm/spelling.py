"""Spelling variants by anagram hashing.

Every letter has a value, a power of its code point, and a word's key is the sum of its
letters' values, whatever their order. Two words that differ by one letter added or
removed have keys that differ by that letter's value; where one letter is exchanged for
another, the keys are equal again once each word's value of its own letter is taken off.
So a word is looked up under its key and under its key less the value of each letter that
it has: no more keys than an alphabet has letters, however long the word.

Rows of one key meet in one place, where the letters' order is verified: a word without
the letter at a place must be the other word, or the other word without a letter at the
same place. Keys of very many rows (anagrams) are dealt on by what is left of a word,
which the words of a pair share. Pairs are never emitted: each word gets the number of
its near words there, and the commonest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartospark.llm.common import run_starts, written
from kartospark.llm.line_dedup import _whole_runs as whole_runs
from kartospark.sources.shared import discard

#: Letters of a word, those of them that are lower-cased, and what they become.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The power that letters' code points are raised to, and the prime that sums are taken modulo.
POWER = 5
MODULUS = (1 << 61) - 1
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: One run in so many is misspelt by ``misspelt``.
SLIP = 199
#: Rows of one key that are kept in one place.
HOT_KEY = 10_000


def misspelt(run: Column, doc_id: Column, slip: int = SLIP) -> Column:
    """The run, without one code point where the checksum of id and run is a multiple of ``slip``; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, slip: int | None = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the words of all texts and how often they occur. Runs are counted within each task before they are shuffled.

    ``slip`` asks for planted misspellings (None: for none).
    """
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    word = F.col("run") if slip is None else misspelt(F.col("run"), F.col("id"), slip)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def keyed(counted: DataFrame) -> DataFrame:
    """``(word, n, key, letter)``: each word under its key (no letter) and, for each letter that it has, under the key without it."""
    split = counted.withColumn("letters", F.split("word", ""))
    whole = split.withColumn("whole", F.aggregate("letters", F.lit(0).cast("long"), lambda total, x: (total + _value(x)) % MODULUS))
    without = F.transform(F.array_distinct("letters"), lambda x: F.struct(F.pmod(F.col("whole") - _value(x), F.lit(MODULUS)).alias("key"), x.alias("letter")))
    return whole.select("word", "n", F.inline(F.concat(F.array(F.struct(F.col("whole").alias("key"), F.lit("").alias("letter"))), without)))


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows of one key together; those of a hot key for each rest, with the place that leaves it (else null). Hot keys are few, as each has many rows."""
    hot = written(rows.groupBy("key").count().where(F.col("count") > HOT_KEY).select(F.col("key").alias("hot")))
    met = rows.join(hot, F.col("key") == F.col("hot"), "left")
    at = F.filter(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.substring("word", i + 1, F.lit(1)) == F.col("letter"))
    rests = F.transform(at, lambda i: F.struct(F.xxhash64("key", F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.length("word")))).alias("key"), i.alias("place")))
    no_place = F.lit(None).cast("int").alias("place")
    dealt = F.when(F.col("hot").isNull(), F.array(F.struct("key", no_place))).when(F.col("letter") == "", F.array(F.struct(F.xxhash64("key", "word").alias("key"), no_place))).otherwise(rests)
    return met.select("word", "n", "letter", F.inline(dealt)).repartition("key").sortWithinPartitions("key")


def _places(word: str, letter: str) -> Iterator[int]:
    at = word.find(letter)
    while at >= 0:
        yield at
        at = word.find(letter, at + 1)


def near_in(rows: list[tuple[str, int, str, int | None]]) -> Iterator[tuple[str, int, int, int, str]]:
    """``(word, n, near words, n of the best, best)`` by what rows ``(word, n, letter, place)`` of one key show.

    Rests are found by their hash, so that long words take no more room than others, and then compared.
    """
    count = {word: n for word, n, _, _ in rows}
    if len(count) < 2:
        return
    alike: dict[tuple[int, int], set[str]] = {}
    longer: dict[int, dict[str, int]] = {}
    for word, _, letter, place in rows:
        for at in () if not letter else _places(word, letter) if place is None else (place,):
            rest = hash(word[:at] + word[at + 1 :])
            alike.setdefault((rest, at), set()).add(word)
            longer.setdefault(rest, {})[word] = at

    def told(words: list[str], others: list[str]) -> Iterator[tuple[str, int, int, int, str]]:
        """For each word that the others but itself are near to it."""
        first = sorted(others, key=lambda w: (-count[w], w))[:2]
        for w in words:
            best = first[0] if first[0] != w else first[1]
            yield w, count[w], len(others) - (words is others), count[best], best

    for (_, at), words in alike.items():
        if len(words) > 1:
            same: dict[str, list[str]] = {}
            for w in words:
                same.setdefault(w[:at] + w[at + 1 :], []).append(w)
            for group in same.values():
                if len(group) > 1:
                    yield from told(group, group)
    for short in {word for word, _, letter, _ in rows if not letter}:
        group = [w for w, at in longer.get(hash(short), {}).items() if w[:at] + w[at + 1 :] == short]
        if group:
            yield from told([short], group)
            yield from told(group, [short])


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("word", "n", "letter", "place")
    for table in whole_runs(batches):
        starts = run_starts(table.column("key").to_numpy())
        rows = list(zip(*(table.column(n).to_pylist() for n in names), strict=True))
        found = [x for a, b in zip(starts, starts[1:], strict=False) if b > a + 1 for x in near_in(rows[a:b])]
        if found:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["word", "n", "n_near", "best_n", "best"])


def near_words(counted: DataFrame) -> DataFrame:
    """``(word, n, n_near, best_n, best)`` for the words that have near ones; ``best`` is the near word of largest n, the smallest of equals.

    Two words differ in one way only, so they are found near under one key and counted once.
    """
    found = _gathered(keyed(counted)).mapInArrow(_near_batches, "word string, n long, n_near long, best_n long, best string")
    one = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), one.alias("one")).select("word", "n", "n_near", (-F.col("one.m")).alias("best_n"), F.col("one.w").alias("best"))


def _rooted(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the word at the end of each chain of forms. Steps double from round to round; a form is ``RATIO`` times as frequent, so few rounds do."""
    at = written(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("w"), F.col("root").alias("r"))
        before, at = at, written(at.join(ahead, F.col("root") == F.col("w")).select("word", F.col("r").alias("root"), (F.col("r") != F.col("root")).alias("moved")))
        discard(before)
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, slip: int | None = None, ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n, n_near, form, form_n, root)``, one row for each word of the texts.

    Words are runs of letters, A-Z in lower case, of ``least_length`` code points and
    ``least_count`` occurrences at least. Two are near if one inserted, deleted or
    replaced code point tells them apart. A word's form is its most frequent near word
    (of equals the smallest in code-point order), if that is ``ratio`` times as frequent;
    its root is the end of the chain of forms, itself if it has none. With ``slip`` one
    run in so many loses a letter first.

    Null and empty texts have no words; null and repeated ids are fine, and repeated rows
    count again. Very long texts and runs are taken whole. An empty table gives an empty
    result. Other columns are not read.
    """
    counted = written(words(docs, slip, least_length, least_count, id_col, text_col))
    near = near_words(counted).select(F.col("word").alias("w"), "n_near", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    kept = F.col("form_n") >= ratio * F.col("n")
    joined = counted.join(near, F.col("word") == F.col("w"), "left")
    forms = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")))
    roots = _rooted(forms).withColumnRenamed("word", "r_word")
    return forms.join(roots, F.col("word") == F.col("r_word")).drop("r_word")
