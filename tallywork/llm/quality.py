"""Quality by nearest-neighbour voting over labelled latent-semantic vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import words as w

SAMPLE_ROWS = 2048  # labelled rows of each label, the whole training set: bounds the model that is sent to the tasks
FEATURES = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 8.0  # a neighbour's vote is its similarity to this power
BLOCK_DOCS = 256  # documents per block of cosine products
_SHAPE = re.compile(r"[^\W\d_]+|\d+|\s+")

_COUNTS = T.StructType([
    T.StructField("feature", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("doc_id", T.LongType()),
])


def _slot(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % FEATURES


def _shape(found: re.Match) -> str:
    x = found[0]
    if x[0].isdigit():
        return "0"
    return "A" if x.isupper() and len(x) > 1 else "Aa" if x[0].isupper() else "a"


class WordFeatures(dict):
    """Feature slots of a word: the word without case, its shape, and its last characters."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) >= w.CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        self[word] = found = (_slot("w" + text.lower()), _slot("s" + _SHAPE.sub(_shape, text)[:12]), _slot("e" + text[-2:]))
        return found


def term_weights(texts: list[bytes], known: WordFeatures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows `(bounds, slots, 1 + log count)` of the texts."""
    split = [text.split() for text in texts]
    ends = w.bounds([3 * len(words) for words in split])
    slots = np.fromiter((s for words in split for x in words for s in known[x]), np.int64, int(ends[-1]))
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    pairs, n = np.unique(owner * FEATURES + slots, return_counts=True)
    return np.searchsorted(pairs, np.arange(len(texts) + 1) * FEATURES), pairs % FEATURES, (1 + np.log(n)).astype(np.float32)


@dataclass
class Voters:
    """`axes`: weight of each slot in each latent dimension; `vectors`: labelled unit vectors; all sizes are fixed."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[bytes], known: WordFeatures) -> np.ndarray:
        bounds, slots, weights = term_weights(texts, known)
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        for part in np.array_split(full, max(1, len(slots) // 20_000)):
            if len(part):
                a, b = bounds[part[0]], bounds[part[-1] + 1]
                out[part] = np.add.reduceat(self.axes[slots[a:b]] * weights[a:b, None], bounds[part] - a, axis=0)
        return _unit(out)

    def score(self, texts: list[bytes], known: WordFeatures) -> np.ndarray:
        """Share of the votes for label 1; without any similar neighbour the share of label 1 among all labels."""
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        latent, k = self.latent(texts, known), min(NEIGHBOURS, len(self.vectors))
        for start in range(0, len(texts), BLOCK_DOCS):
            near = latent[start:start + BLOCK_DOCS] @ self.vectors.T
            top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k:]
            vote = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = vote.sum(axis=1)
            good = (vote * self.labels[top]).sum(axis=1)
            out[start:start + BLOCK_DOCS] = np.where(total > 0, good / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 1e-9)


def _latent_axes(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    basis = np.random.default_rng(7).standard_normal((rows.shape[1], min(dimensions + 16, *rows.shape))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :dimensions]


def training_rows(doc_id: Column) -> Column:
    """Rows to learn from; a row without id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("feature", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32())), ("label", pa.int32()), ("doc_id", pa.int64())])
    known = WordFeatures()
    for batch in w.blocks(batches):
        bounds, slots, weights = term_weights(w.texts(batch), known)
        at = pa.array(bounds, pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(at, pa.array(slots, pa.int32())), pa.ListArray.from_arrays(at, pa.array(weights)),
            batch.column("label").cast(pa.int32()), batch.column("doc_id").cast(pa.int64()),
        ], schema=schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Voters:
    """Voters from at most `sample_rows` rows of each label of `labels(doc_id, quality)`, the lowest in a fixed mix of
    the ids, among those whose id may be learned from. Rows without id, text or label are left out; an id that has both
    labels counts once under each, with its smallest text if the id is repeated, so there are never more voters than the
    sample has rows. Voters are in the order of their ids."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    own = own.where(training_rows(F.col("doc_id"))).distinct()
    n = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    mix = F.xxhash64("doc_id")
    chosen = [own.where(F.col("label") == k).orderBy(mix, "doc_id").limit(sample_rows) for k in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # two times `sample_rows` rows of two numbers
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(sample, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(_weights, _COUNTS).toPandas().sort_values(["doc_id", "label"])
    if not len(found):
        return Voters(np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    dense = np.zeros((len(found), FEATURES), np.float32)
    for k, (feature, weight) in enumerate(zip(found["feature"], found["weight"])):
        dense[k, np.asarray(feature, np.int64)] = weight
    rarity = np.log((1 + len(dense)) / (1 + (dense > 0).sum(axis=0))).astype(np.float32) + 1
    axes = _latent_axes(_unit(dense * rarity), DIMENSIONS)
    axes = (rarity[:, None] * axes).astype(np.float32)
    return Voters(axes, _unit(dense @ axes), found["label"].to_numpy(np.float64), prior)


def _scored(voters: Voters, schema: pa.Schema, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in w.blocks(batches):
            score = voters.value.score(w.texts(batch), known)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(batch.column(c) for c in carry), pa.array(score),
                pa.array((score >= 0.5).astype(np.int32)),
            ], schema=schema)

    return w.released(run)


def classify(docs: DataFrame, voters: Voters, carry: tuple[str, ...] = ()) -> DataFrame:
    """`(doc_id, carried columns, score, predicted)` for each row of `docs(doc_id, text)`: exact cosine products with
    all labelled vectors, block by block, in the task that reads the row.

    The model is broadcast; its size is fixed by SAMPLE_ROWS, FEATURES and DIMENSIONS (about 2 MB). Nulls: a null text is
    empty; a text without words has the share of label 1 among all labels as its score. Of neighbours that tie for the
    last vote, numpy's partition of the voters in their fixed order picks the same ones for equal texts. Repeated rows are scored each
    for itself. Columns that are not carried are not read. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([
        docs.schema["doc_id"], *(docs.schema[c] for c in carry), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    ])
    sent = docs.sparkSession.sparkContext.broadcast(voters)
    columns = list(dict.fromkeys(("doc_id", "text", *carry)))
    return docs.select(*columns).mapInArrow(_scored(sent, to_arrow_schema(out), list(carry)), out)
