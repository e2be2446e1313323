"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard confirmation, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import cut
from . import words as w
from .graph import components

SHINGLE_WORDS = 5
BAND_ROWS = 3
BANDS = 24  # a pair at similarity 0.75 shares no band with probability (1 - 0.75^3)^24 = 2e-6
SLICE = 1 << 15  # shingles per numpy step: stays in the processor's cache
_SIGMA, _PI = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("hi", T.LongType()),
    T.StructField("lo", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
])
SETS = T.StructType([
    T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()),
    T.StructField("shingles", T.ArrayType(T.LongType())),
])


def shingle_sets(documents: list[bytes], known: w.WordNumbers) -> list[np.ndarray]:
    """The sorted distinct shingle numbers of each text."""
    split = [text.lower().split() for text in documents]
    values, ends = w.numbers(split, known)
    grams = w.grams(values, SHINGLE_WORDS)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= SHINGLE_WORDS:
            own = np.sort(grams[a:b - SHINGLE_WORDS + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(w.grams(values[a:b], b - a) if b > a else values[:0])
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    number = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (number >> 64) - (1 << 63), (number & (1 << 64) - 1) - (1 << 63)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one permutation sigma scatters the shingles, a second one, pi, shifted by k
    places on the circle of 2^64 numbers, gives coordinate k."""
    out = np.full((coordinates, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= SLICE):
            size += len(sets[last])
            last += 1
        starts = w.bounds([len(s) for s in sets[first:last]])[:-1]
        scattered = w.mixed(np.concatenate(sets[first:last]) ^ _SIGMA)
        for k in range(coordinates):
            out[k, first:last] = np.minimum.reduceat(w.mixed(scattered + np.uint64(k) ^ _PI), starts)
        first = last
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64()))])
    known = w.WordNumbers()
    for batch in w.blocks(batches):
        sets = shingle_sets(w.texts(batch), known)
        full = [s for s in sets if len(s)]
        signs = signatures(full, BANDS * BAND_ROWS)
        keys = np.empty((len(full), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for row in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
                key = w.mixed(key * np.uint64(31) + signs[row])
            keys[:, band] = key
        at, bands = iter(w.signed(keys).tolist()), []
        for s in sets:
            bands.append(next(at) if len(s) else None)
        marks = [digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
            pa.array(bands, pa.list_(pa.int64())),
        ], schema=schema)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    known = w.WordNumbers()
    for batch in w.blocks(batches):
        sets = shingle_sets(w.texts(batch), known)
        marks = [digest(s) for s in sets]
        joined = w.signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(w.bounds([len(s) for s in sets]), pa.int32()), pa.array(joined))
        yield pa.RecordBatch.from_arrays([
            pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), lists,
        ], schema=schema)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs(a, b)` whose full sets have 100 * intersection >= 75 * union."""
    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_a", "_b")).cast("long")
    total = F.size("_a").cast("long") + F.size("_b") - common
    return both.where(common * 100 >= total * 75).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)` for each row of `docs(doc_id, text)`.

    Equal shingle sets form one class from the start, so copies never meet in a bucket. In each bucket of the banding
    every member is compared with one centre, the member that shares most buckets. Buckets that then still hold more
    than one component go on to a second comparison: of their members those pairs are compared that exact bounds on
    sizes and on shared rare shingles allow to be linked. So no link between two members of a bucket is lost, unless
    both are in one component already, and no bucket is ever written out as pairs.

    Nulls: a null text is empty; an empty set links with nothing. A row without doc_id takes part like any other, can
    give no component id, and is kept when its component has no id at all. Repeated rows are copies; several rows with
    the smallest id are all kept. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(docs.mapInArrow(w.released(_sketches), SKETCH), "sketch")
    classes = cut(
        sketch.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
        .withColumn("c", F.monotonically_increasing_id()), "classes",
    )
    one_each = sketch.join(classes, ["hi", "lo"]).where(F.col("doc_id").eqNullSafe(F.col("rep")))
    rows = one_each.select("c", F.explode("bands").alias("key"))
    # The rows of a class that has its smallest id twice only make a bucket look larger.
    shared = rows.groupBy("key").agg(F.min("c").alias("_low"), F.max("c").alias("_high"), F.count("*").alias("n"))
    buckets = cut(rows.join(shared.where("_low < _high").select("key", "n"), "key").distinct(), "buckets")
    wanted = cut(classes.join(buckets.select("c").distinct(), "c", "left_semi"), "wanted")
    reps = wanted.select("rep").distinct().hint("merge")  # grows with the corpus: the same plan at every size
    bodies = docs.join(reps, docs.doc_id.eqNullSafe(reps.rep), "left_semi").mapInArrow(w.released(_full_sets), SETS)
    # A class whose smallest id is repeated has several equal rows here; the join has put them side by side.
    sets = cut(bodies.join(wanted.select("hi", "lo", "c"), ["hi", "lo"]).dropDuplicates(["hi", "lo"]).select("c", "shingles"), "sets")
    found = _linked(buckets, sets)
    smallest = (
        classes.join(found, "c", "left").withColumn("component", F.coalesce("component", "c"))
    )
    ids = smallest.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = smallest.join(ids, "component").select("hi", "lo", "component_id")
    full = sketch.where("n_shingles > 0").join(by_class, ["hi", "lo"])
    empty = sketch.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return full.select(columns).union(empty.select(columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of those buckets that still hold more than one component."""
    now = buckets.select("key", "c").join(found, "c", "left").withColumn("component", F.coalesce("component", "c"))
    mixed = now.groupBy("key").agg(F.min("component").alias("_l"), F.max("component").alias("_h")).where("_l < _h")
    return now.join(mixed.select("key"), "key", "left_semi")


def _centres(buckets: DataFrame) -> DataFrame:
    """Pairs of each member of a bucket with the member that shares most buckets with others."""
    popular = buckets.groupBy("c").agg(F.sum("n").alias("_popular"))
    centre = buckets.join(popular, "c").groupBy("key").agg(F.max_by("c", "_popular").alias("b"))
    return buckets.join(centre, "key").where("c <> b").select(
        F.greatest("c", "b").alias("a"), F.least("c", "b").alias("b")
    ).distinct()


def _by_prefix(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components of `rest(c, component)` that can be linked, by exact bounds.

    Shingles are put in one order, rare ones first. Two sets at 0.75 or more share a shingle among the first quarter of
    the longer and the first seventh of the shorter one, and behind the first such shingle both are long enough.
    """
    own = sets.join(rest, "c")
    rows = own.select("c", "component", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    # A shingle of one set alone can't be shared; its place in the order still counts.
    ranked = rows.join(often, "s", "left").groupBy("c", "component").agg(
        F.count("*").cast("int").alias("size"), F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)).cast("int").alias("alone"),
        F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "s")))).alias("shared"),
    )
    placed = ranked.select("c", "component", "size", "alone", F.posexplode("shared").alias("k", "_s")).select(
        "c", "component", "size", F.col("_s.s").alias("s"), (F.col("alone") + F.col("k")).alias("place"),
    ).where(F.col("place") * 4 <= F.col("size"))
    placed = cut(placed, "prefixes")
    long = placed.select("s", F.col("c").alias("a"), F.col("size").alias("_la"), F.col("place").alias("_pa"), F.col("component").alias("_ca"))
    short = placed.where(F.col("place") * 7 <= F.col("size")).select(
        "s", F.col("c").alias("b"), F.col("size").alias("_lb"), F.col("place").alias("_pb"), F.col("component").alias("_cb")
    )
    behind = F.least(F.col("_la") - F.col("_pa"), F.col("_lb") - F.col("_pb"))
    fits = (
        (long["s"] == short["s"]) & (F.col("_ca") != F.col("_cb")) & (F.col("_lb") * 4 >= F.col("_la") * 3)
        & ((F.col("_la") > F.col("_lb")) | ((F.col("_la") == F.col("_lb")) & (F.col("a") > F.col("b"))))
        & (behind * 7 >= (F.col("_la") + F.col("_lb")) * 3)
    )
    return long.join(short, fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _linked(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """`(c, component)` of classes that share a bucket."""
    links = cut(_confirmed(_centres(buckets), sets), "links")
    found = cut(components(links).select(F.col("v").alias("c"), "component"), "found")
    rest = cut(_open(buckets, found).select("c", "component").distinct(), "rest")
    if rest.isEmpty():
        return found
    more = cut(_confirmed(_by_prefix(rest, sets), sets), "links")
    return components(links.union(more)).select(F.col("v").alias("c"), "component") if not more.isEmpty() else found
