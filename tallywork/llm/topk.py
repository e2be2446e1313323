"""Exact top-k inner products: everything is scored in blocks, global histograms of the scores are refined until each
query's k-th place is known, and what lies at or above it is ranked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut

BINS = 1024  # of a histogram; a round narrows the range of a query so many times
GROUP_QUERIES = 4096  # queries scored by one task
AT_ONCE = 512  # queries scored against a block in one go
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 19  # vectors of a block, and their components with padding
SLICE_BYTES = 32 << 20  # candidates scored by one task
_MOST = 1 << 53  # components are held between minus and plus this
_LIMIT = 1 << 61  # and scores between these
_LOW_HALF = (1 << 32) - 1
_TYPES = ("i1", "i2", "i4", "i8")


def _matrices(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors as whole numbers, blocks of similar size; shorter vectors end in zeros. Rows that take no part are left out."""
    for batch in batches:
        vectors = batch.column("vector")
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(len(sizes)), sizes)
        usable = pc.and_(vectors.is_valid(), batch.column("id").is_valid()).to_numpy(zero_copy_only=False).copy()
        usable[own[~np.isfinite(values)]] = False
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.clip(np.floor(np.nan_to_num(values) * scale), -_MOST, _MOST).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = pc.fill_null(batch.column("id"), 0).to_numpy(zero_copy_only=False)
        rows, widest = [], 0

        def block() -> tuple[np.ndarray, np.ndarray]:
            at = np.array(rows)
            out = np.zeros((len(at), max(1, widest)), np.int64)
            out[np.arange(out.shape[1]) < sizes[at, None]] = whole[np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])]
            return ids[at], out

        for row in np.flatnonzero(usable).tolist():
            if rows and (len(rows) == BLOCK_ROWS or (len(rows) + 1) * max(widest, int(sizes[row])) > BLOCK_VALUES):
                yield block()
                rows, widest = [], 0
            rows.append(row)
            widest = max(widest, int(sizes[row]))
        if rows:
            yield block()


def _candidates(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for ids, matrix in _matrices(batches, scale):
            most = int(np.abs(matrix).max())
            kind = next(t for t in _TYPES if most <= np.iinfo(t).max)
            yield pa.RecordBatch.from_pylist([{
                "block": number, "kind": kind, "rows": len(ids), "most": float(most), "low": int(ids.min()), "high": int(ids.max()),
                "ids": ids.tobytes(), "data": matrix.astype(kind).tobytes(),
            }])
            number += 1

    return run


def _queries(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _matrices(batches, scale):
            size = np.abs(matrix).sum(axis=1, dtype=np.float64)
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(ids, pa.int64()), "size": pa.array(size), "query": pa.array([v.tobytes() for v in matrix], pa.binary()),
            })

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, held between -_LIMIT and _LIMIT."""
    shared = min(a.shape[1], b.shape[1])
    a, b = a[:, :shared].astype(np.int64), b[:, :shared].astype(np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * shared
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most <= _LIMIT:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -_LIMIT, _LIMIT).astype(np.int64)


def _blocks(asked: pa.Table, given: pa.Table) -> Iterator[tuple]:
    """Queries `AT_ONCE` at a time with each block of candidates: places of the queries, their scores (below every range
    where a candidate has the query's id) and the candidates' ids."""
    vectors = [np.frombuffer(x.as_py(), np.int64) for x in asked.column("query")]
    own = asked.column("query_id").to_numpy()
    for start in range(0, len(vectors), AT_ONCE):
        some = vectors[start:start + AT_ONCE]
        matrix = np.zeros((len(some), max(map(len, some))), np.int64)
        for row, vector in zip(matrix, some):
            row[:len(vector)] = vector
        at = np.arange(start, start + len(some))
        for kind, ids, data in zip(*(given.column(c).to_pylist() for c in ("kind", "ids", "data"))):
            ids = np.frombuffer(ids, np.int64)
            scores = products(matrix, np.frombuffer(data, kind).reshape(len(ids), -1))
            order = np.argsort(own[at], kind="stable")
            there = np.isin(ids, own[at])
            for column in np.flatnonzero(there).tolist():
                low, high = (np.searchsorted(own[at], ids[column], side, sorter=order) for side in ("left", "right"))
                scores[order[low:high], column] = -2 * _LIMIT
            yield at, scores, ids


def _digits(scores: np.ndarray, ids: np.ndarray, state: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The digit of its place that each query refines: the score, then the upper and the lower half of the id, smaller
    ids first. Candidates that are apart in an earlier digit are below every range."""
    upper, lower = -(ids >> 32), -(ids & _LOW_HALF)
    phase, score, half = (state[c][at, None] for c in ("phase", "score", "half"))
    same = scores == score
    return np.where(phase == 0, scores, np.where(
        (phase == 1) & same, upper, np.where((phase == 2) & same & (upper == half), lower, -2 * _LIMIT)
    ))


_STATE = ("phase", "score", "half", "low", "high", "above")


def _histograms(k: int):
    def run(key, asked: pa.Table, given: pa.Table) -> pa.Table:
        state = {c: asked.column(c).to_numpy() for c in _STATE}
        count = np.zeros((asked.num_rows, BINS), np.int64)
        step = -(-(state["high"] - state["low"] + 1) // BINS)
        for at, scores, ids in _blocks(asked, given):
            digit = _digits(scores, ids, state, at)
            inside = (digit >= state["low"][at, None]) & (digit <= state["high"][at, None])
            row, column = np.nonzero(inside)
            bin_ = (digit[row, column] - state["low"][at][row]) // step[at][row]
            count[at] += np.bincount(row * BINS + bin_, minlength=len(at) * BINS).reshape(len(at), BINS)
        # Bins below the place that the candidates of this task alone reach can't hold the place among all of them.
        over = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] - count
        row, column = np.nonzero((count > 0) & (over < (k - state["above"])[:, None]))
        q = asked.column("q").to_numpy()
        return pa.table({"q": q[row], "bin": column.astype(np.int64), "n": count[row, column]})

    return run


def _reached(k: int):
    def run(key, asked: pa.Table, given: pa.Table) -> pa.Table:
        state = {c: asked.column(c).to_numpy() for c in _STATE}
        q, own, best = asked.column("q").to_numpy(), asked.column("query_id").to_numpy(), {}
        for at, scores, ids in _blocks(asked, given):
            digit = _digits(scores, ids, state, at)
            phase, score, half = (state[c][at, None] for c in ("phase", "score", "half"))
            before = (phase > 0) & ((scores > score) | (phase > 1) & (scores == score) & (-(ids >> 32) > half))
            row, column = np.nonzero(((digit >= state["low"][at, None]) | before) & (scores >= -_LIMIT))
            found, number = (scores[row, column], ids[column]), at[row]
            if start := best.get(int(at[0])):
                number, found = np.concatenate((start[0], number)), tuple(np.concatenate(x) for x in zip(start[1], found))
            order = np.lexsort((found[1], -found[0], number))
            number, found = number[order], tuple(x[order] for x in found)
            first = np.searchsorted(number, number)
            kept = np.arange(len(number)) - first < k
            best[int(at[0])] = number[kept], tuple(x[kept] for x in found)
        number = np.concatenate([x for x, _ in best.values()]) if best else np.zeros(0, np.int64)
        found = [np.concatenate([f[j] for _, f in best.values()]) if best else np.zeros(0, np.int64) for j in (0, 1)]
        return pa.table({"q": q[number], "query_id": own[number], "score": found[0], "vec_id": found[1]})

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: for each distinct row of `queries(id, vector)` the `k` rows of
    `candidates(id, vector)` with the highest inner product, ties to the smaller id; components are first turned into
    floor(`scale` * x). Rows with the query's own id are not its candidates.

    Queries (in groups) meet candidates (in slices of packed blocks), so every score is computed, in blocks, and none is
    written. Each round, a task counts its scores in `BINS` bins of each query's range and passes on the bins that can
    hold the k-th; their sums over all tasks narrow the range. Where equal scores are left beyond twice `k`, the range goes
    on over the ids, so ties are cut at the right id however many there are. Then what is at or above the k-th
    place is passed on, at most `k` rows a query and slice, and ranked.

    Nulls: rows without id or vector, or with a component that is null or not finite, take no part. Vectors of different
    length share the components both have. Components beyond 2^53 count as 2^53, scores beyond 2^61 as 2^61. Repeated rows of
    candidates take a rank each, repeated queries are one; an id with several vectors is asked for each. Fewer than `k` candidates:
    all. Empty tables give an empty result. Other columns are not read."""
    spark = candidates.sparkSession
    blocks = cut(candidates.select("id", "vector").mapInArrow(
        _candidates(scale), "block long, kind string, rows long, most double, low long, high long, ids binary, data binary"
    ), "blocks")
    asked = queries.select("id", "vector").where("id is not null and vector is not null").mapInArrow(
        _queries(scale), "query_id long, size double, query binary"
    )
    facts = blocks.agg(
        F.sum(F.length("data") + F.length("ids")).alias("bytes"), F.max("most").alias("most"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    ).first()
    low_id, high_id = facts["low"] or 0, facts["high"] or 0
    upper = (-(high_id >> 32), -(low_id >> 32))
    lower = (-(high_id & _LOW_HALF), -(low_id & _LOW_HALF)) if upper[0] == upper[1] else (-_LOW_HALF, 0)
    bound = F.least(F.lit(float(_LIMIT)), F.col("size") * (facts["most"] or 0.0) * 1.000001 + 1).cast("long")
    slices = max(1, -(-(facts["bytes"] or 0) // SLICE_BYTES))
    state = cut(asked.distinct().select(
        F.monotonically_increasing_id().alias("q"), "query_id", "query", F.lit(0).alias("phase"), F.lit(0).cast("long").alias("score"),
        F.lit(0).cast("long").alias("half"), (-bound).alias("low"), bound.alias("high"), F.lit(0).cast("long").alias("above"),
    ), "queries")

    def against_all(rows: DataFrame, fn, schema: str) -> DataFrame:
        groups = max(1, -(-rows.count() // GROUP_QUERIES))
        left = rows.withColumn("_group", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")).withColumn(
            "_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        right = blocks.select("kind", "ids", "data", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("_slice")).withColumn(
            "_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return left.groupBy("_group", "_slice").cogroup(right.groupBy("_group", "_slice")).applyInArrow(fn, schema)

    done = None
    while not state.isEmpty():
        bins = against_all(state, _histograms(k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        over = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        need = F.lit(k) - F.col("above")
        placed = bins.withColumn("_over", over).join(state.select("q", "above"), "q").where((F.col("_over") < need) & (F.col("_over") + F.col("n") >= need))
        step = F.expr(f"(high - low + {BINS}) div {BINS}")
        at = F.col("low") + F.col("bin") * step
        found = state.join(placed.select("q", "bin", "n", "_over"), "q", "left").withColumns({
            "_low": F.coalesce(at, "low"), "_high": F.coalesce(F.least(at + step - 1, "high"), "high"),
            "above": F.col("above") + F.coalesce("_over", F.lit(0)),
        })
        alone = F.col("_low") == F.col("_high")
        found = found.withColumn(
            "_done", F.col("bin").isNull() | (F.col("above") + F.col("n") <= 2 * k) | (alone & (F.col("phase") == 2))
        )
        found = cut(found, "places")
        ended = found.where("_done").select(*[c for c in state.columns if c not in ("low", "high")], F.col("_low").alias("low"), F.col("_high").alias("high"))
        done = ended if done is None else done.unionByName(ended)
        goes_on = alone & (F.col("phase") < 2)
        skip = upper[0] == upper[1]
        phase = F.when(goes_on, F.when((F.col("phase") == 0) & F.lit(not skip), 1).otherwise(2)).otherwise(F.col("phase"))
        ranges = {name: (F.when(goes_on & (phase == 1), F.lit(one)).when(goes_on, F.lit(two)).otherwise(F.col(f"_{name}")))
                  for name, one, two in (("low", upper[0], lower[0]), ("high", upper[1], lower[1]))}
        state = cut(found.where("not _done").select(
            "q", "query_id", "query", phase.cast("int").alias("phase"),
            F.when(goes_on & (F.col("phase") == 0), F.col("_low")).otherwise(F.col("score")).alias("score"),
            F.when(goes_on & (F.col("phase") == 1), F.col("_low")).when(goes_on & F.lit(skip), F.lit(upper[0])).otherwise(F.col("half")).alias("half"),
            *(c.cast("long").alias(n) for n, c in ranges.items()), "above",
        ), "queries")
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = against_all(done, _reached(k), "q long, query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
