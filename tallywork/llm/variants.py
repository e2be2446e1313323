"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the commoner word each is a form of."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut
from . import words as w

LEAST_LENGTH, LEAST_COUNT = 5, 3
DIVISOR = 97  # runs whose check sum it divides lose a code point
HELD_WORDS = 300_000  # words a task counts before it passes them on
BUCKET_PAIRS = 1 << 14  # chunk words times gram words of one key; keys beyond it are split by the rest of their words
_RUN = re.compile("[a-zÀ-ÿ]+")


def _counts(least: int, divisor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return rows

        for batch in w.blocks(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), w.texts(batch)):
                start = zlib.crc32(b"" if doc is None else b"%d" % doc)
                start = zlib.crc32(b":", start)
                for word, times in Counter(_RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    if len(word) >= least:
                        check = zlib.crc32(word.encode(), start)
                        if check % divisor == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                        found[word] += times
            if len(found) > HELD_WORDS:
                yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, divisor: int = DIVISOR) -> DataFrame:
    """`(word, n)`: the distinct lower-cased runs of letters of all whole texts, with their occurrences. In a text, a run
    whose check sum with the document's id `divisor` divides is read without one of its code points."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_counts(least_length, divisor), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _sides(words: DataFrame) -> DataFrame:
    """The words as both sides, with nothing matched so far: `whole` is the length of the word that gives the chunks, and
    `rest` what is left to match. A word gives grams to words of its own length and to those one shorter."""
    size = F.length("word")
    gives = F.struct(F.lit(True).alias("chunks"), size.alias("whole"))
    takes = [F.struct(F.lit(False).alias("chunks"), (size - less).alias("whole")) for less in (0, 1)]
    rows = words.select("word", "n", F.explode(F.array(gives, *takes)).alias("s"))
    return rows.select("word", "n", "s.chunks", F.col("s.whole").alias("left"), F.col("word").alias("rest"), F.col("s.whole").cast("string").alias("key"))


def _keyed(rows: DataFrame) -> DataFrame:
    """A row for each of the two places. The chunk word's `rest` has two disjoint chunks, its first and its last half; the
    other word has its grams of that size. One edit leaves the first half where it is, or shifts the last half by the
    difference of the lengths, so of all grams within shift one only those two can be the chunk left whole."""
    half = F.floor(F.col("left") / 2).cast("int")
    size = F.length("rest")
    first = F.struct(F.lit("<").alias("at"), F.substring("rest", 1, half).alias("gram"), F.substring("rest", half + 1, size).alias("rest"))
    last = F.struct(F.lit(">").alias("at"), F.substring("rest", size - half + 1, half).alias("gram"), F.substring("rest", 1, size - half).alias("rest"))
    split = rows.select("word", "n", "chunks", (F.col("left") - half).alias("left"), "key", F.explode(F.array(first, last)).alias("p"))
    return split.select("word", "n", "chunks", "left", F.concat("key", "p.at", "p.gram").alias("key"), "p.rest")


def _joined(rows: DataFrame) -> DataFrame:
    """Pairs of one edit within a key; the rest of two words is one edit apart where the words are."""
    a = rows.where("chunks").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("_a"))
    b = rows.where("not chunks").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("_b"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))  # of two words of a length the smaller gives the chunks
    near = (F.levenshtein("_a", "_b", 1) == 1) & once
    return a.join(b.hint("merge"), (a.key == b.key) & near).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """`(a, a_n, b, b_n)`: each pair of the distinct words `words(word, n)` exactly one inserted, deleted or replaced code
    point apart, once; `a` is the shorter, or the smaller of two of the same length.

    Words meet on (length, place, chunk). Where a key holds more than `bucket_pairs` combinations, its words are split
    again by what is left of them, in two chunks as before, as often as needed: in the end words of a key differ in one
    code point, and there are no more of these than code points. Pairs are checked inside the join and never written
    out unchecked."""
    found, rows = [], _keyed(_sides(words))
    while True:
        rows = cut(rows, "keys")
        sizes = rows.groupBy("key").agg(F.sum(F.col("chunks").cast("long")).alias("a"), F.sum((~F.col("chunks")).cast("long")).alias("b"), F.max("left").alias("left"))
        hot = cut(sizes.where((F.col("a") * F.col("b") > bucket_pairs) & (F.col("left") > 1)).select("key"), "hot_keys")
        if hot.isEmpty():
            found.append(_joined(rows))
            break
        found.append(_joined(rows.join(hot, "key", "left_anti")))
        rows = _keyed(rows.join(hot, "key", "left_semi"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()  # a pair that agrees in both chunks met twice


def _last(forms: DataFrame) -> DataFrame:
    """`(word, root)` by doubling: each step follows all forms twice as far. Counts at least double along a chain, so
    a chain of 63 forms is the longest there can be, which six steps cover."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(at.join(onward, "root", "left").select("word", "root", "_next"), "roots")
        at = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.where("_next is not null").isEmpty():
            return at


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)` for each of the distinct words `words(word, n)`.

    The form of a word is its near word with the largest count (of ties the smallest in code-point order) if that is at
    least `times` its own count, else null; the root is the last of the forms from there on, the word itself if it has none."""
    words = cut(words.select("word", "n"), "vocabulary")
    pairs = cut(near_pairs(words), "near_pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    judged = words.join(near, "word", "left").withColumn("_is", -F.col("_best.less") >= times * F.col("n"))
    judged = cut(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_is"), F.col("_best.near")).alias("form"),
        F.when(F.col("_is"), -F.col("_best.less")).alias("form_n"),
    ), "forms")
    roots = _last(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """`group_variants` of the vocabulary of `docs(doc_id, text)`.

    Nulls: a null or empty text has no words; the id of a row without one is spelled as nothing. Repeated rows count
    each. Other columns are not read. An empty table, or one without words that occur often enough, gives an empty
    result. Very long texts are read whole, one at a time."""
    return group_variants(vocabulary(docs))
