"""What every job needs from the cluster: session settings, cut points, ordered numbering, running totals."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Settings the plans count on. All are runtime settings, so they can be laid over any session.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time, also where the split costs one more exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Rows per block of source positions. A window over one block never sees more rows than this.
BLOCK_ROWS = 1 << 20

# Places that groups are hashed into to find hot ones (`hot_places`).
PLACES = 1 << 14

_fallback_dir: dict[str, str] = {}
_written: list[str] = []
_tables: list[str] = []
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: functions run in tasks are found by module name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tallywork-"), "tallywork.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def prepare_session(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for name, value in SESSION_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut points: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dir:
        _fallback_dir[app] = tempfile.mkdtemp(prefix="tallywork-")
    return _fallback_dir[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared scratch folder, which `release_scratch` deletes."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new name for a scratch table of the session's catalog, which `release_scratch` drops."""
    table = f"{name}_{uuid.uuid4().hex}"
    _tables.append(table)
    return table


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: a short plan that survives lost executors. `options` are
    those of the Parquet writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> int:
    """Delete the tables `cut` wrote in this process, and those of `scratch_table` from the catalog. Call it once every result has been written out."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


def numbered(df: DataFrame, order_by: list, name: str, start: int = 1) -> DataFrame:
    """A gap-free global number in the given order (names or columns), without a one-partition window.

    `order_by` must end in a unique column. Rows are range-partitioned and sorted; each keeps its place inside its
    partition, and the partition offsets (one row per partition) are broadcast.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = cut(ordered.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + inside + F.lit(start)).cast("bigint"))
        .drop("_place", "_part", "_offset")
    )


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows by key into as many partitions as the session shuffles into. Groups worked on in Python are small in
    bytes and heavy in time, so they must not be coalesced into a few tasks by size."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, df.sparkSession.sparkContext.defaultParallelism), *keys)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Lay the columns of a one-row frame beside every row. `one_row` must be an aggregate without grouping keys, which
    has exactly one row whatever the size of its input; nothing else may be passed."""
    return df.crossJoin(F.broadcast(one_row))


def join_filled(df: DataFrame, other: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Left join on text keys of which a blank (empty or null) is none: such rows find nothing, and are spread by `spread_by` (a column
    with many values) in place of their first key, so that a blank in a third of all rows never lands in one task.

    `other` must hold no blank first key. Rows keep all their columns; keys that are not text may follow the first.
    """
    first, rest = keys[0], keys[1:]
    blank = F.coalesce(F.col(first), F.lit("")) == ""
    # No key begins with NUL, so the stand-ins of blank keys meet nothing.
    lead = F.when(blank, F.concat(F.lit("\x00"), F.coalesce(F.col(spread_by).cast("string"), F.lit("")))).otherwise(F.col(first))
    known = other.filter(F.coalesce(F.col(first), F.lit("")) != "").withColumnRenamed(first, "_lead")
    return df.withColumn("_lead", lead).join(known, ["_lead", *rest], "left").drop("_lead")


def join_known(df: DataFrame, other: DataFrame, keys: list[str], spread_by: list[str]) -> DataFrame:
    """Left join on keys of any type of which a null is none: rows with a null key find nothing, and are spread by `spread_by` (columns with
    many values), so that keys which are null in a third of all rows never land in one task."""
    blank = F.col(keys[0]).isNull()
    for name in keys[1:]:
        blank = blank | F.col(name).isNull()
    # Known keys all have the same second key, so they meet as before.
    place = F.when(blank, F.xxhash64(*spread_by)).otherwise(F.lit(0).cast("bigint"))
    return df.withColumn("_place", place).join(other.withColumn("_place", F.lit(0).cast("bigint")), [*keys, "_place"], "left").drop("_place")


def with_block(df: DataFrame, position: str) -> DataFrame:
    """Adds `_block`, a stretch of at most BLOCK_ROWS positions, unless the frame has it already."""
    if "_block" in df.columns:
        return df
    return df.withColumn("_block", F.floor(F.col(position) / F.lit(BLOCK_ROWS)).cast("bigint"))


def _before(keys: list[str], by: str):
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def _known(df: DataFrame, columns: list[str]) -> DataFrame:
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def _place(group: list[str]) -> Column:
    return F.pmod(F.xxhash64(*group), F.lit(PLACES))


def hot_places(frames: list[DataFrame], group: list[str]) -> list[int]:
    """The places that hold more than BLOCK_ROWS rows of the frames together. A group outside of them has at most that many
    rows, so one window may hold it; groups inside take ways that split them.

    Every row is counted, in one aggregate of at most PLACES rows a task, whatever the number of groups. Beyond PLACES times
    BLOCK_ROWS rows all places are hot. Rows without a group are not counted.
    """
    keys = frames[0].select(*group)
    for more in frames[1:]:
        keys = keys.unionByName(more.select(*group))
    counted = _known(keys, group).groupBy(_place(group).alias("_place")).agg(F.count("*").alias("_n"))
    return sorted(r["_place"] for r in counted.filter(F.col("_n") > BLOCK_ROWS).collect())


def in_places(group: list[str], places: list[int]) -> Column:
    """Whether the group of a row is in one of the places."""
    return _place(group).isin(places)


def by_heat(df: DataFrame, group: list[str], hot: list[int] | None, cool, heavy) -> DataFrame:
    """`cool` of the rows whose group is in no hot place and `heavy` of the others, which are written first. `hot` must be the
    places of a frame with at least the groups' rows of `df`; None finds them."""
    hot = hot_places([df], group) if hot is None else hot
    if not hot:
        return cool(df)
    inside = in_places(group, hot)
    return cool(df.filter(~inside)).unionByName(heavy(cut(df.filter(inside), "hot")))


def _with_place(df: DataFrame, order: str, position: str) -> DataFrame:
    """Rows that have a place in their group; the others count for later rows, but are left out themselves."""
    return _known(df, [order, position, *(["_block"] if "_block" in df.columns else [])])


def running_before(
    df: DataFrame, group: list[str], order: str, position: str, values: dict[str, Column],
    largest: dict[str, Column] | None = None, hot: list[int] | None = None,
) -> DataFrame:
    """Sum of each value over the earlier rows of the group, ordered by (`order`, `position`); of `largest` the greatest
    value there, null where there is none.

    `position` must be a whole number unique inside one `order` value; rows without them come first, and are left out of the result.
    Groups in no hot place take one window and one shuffle, which later steps by the same group share. The others take three levels,
    so that no window holds more than a block: totals per `order` value, totals per block of positions inside one `order`
    value, and rows inside one block (at most BLOCK_ROWS). The result keeps `_block`.
    """
    largest = largest or {}
    before = Window.partitionBy(*group).orderBy(order, position).rowsBetween(Window.unboundedPreceding, -1)

    def cool(rows: DataFrame) -> DataFrame:
        sums = {n: F.coalesce(F.sum(v).over(before), F.lit(0)) for n, v in values.items()}
        return with_block(_with_place(rows.withColumns(sums | {n: F.max(v).over(before) for n, v in largest.items()}), order, position), position)

    def heavy(rows: DataFrame) -> DataFrame:
        return _running_levels(rows, group, order, position, values, largest)

    return by_heat(_known(df, group), group, hot, cool, heavy)


def _running_levels(
    df: DataFrame, group: list[str], order: str, position: str, values: dict[str, Column], largest: dict[str, Column]
) -> DataFrame:
    names, zero = [*values, *largest], F.lit(0)
    rows = with_block(df, position).withColumns({f"_v_{n}": v for n, v in (values | largest).items()})

    def total(n: str, column: str) -> Column:
        return F.sum(column) if n in values else F.max(column)

    def over(n: str, column: str, window) -> Column:
        out = total(n, column).over(window)
        return F.coalesce(out, zero) if n in values else out

    def joined(n: str, *parts: Column) -> Column:
        return parts[0] + parts[1] + parts[2] if n in values else F.greatest(*parts)

    by_block = rows.groupBy(*group, order, "_block").agg(*[total(n, f"_v_{n}").alias(f"_s_{n}") for n in names])
    by_order = by_block.groupBy(*group, order).agg(*[total(n, f"_s_{n}").alias(f"_t_{n}") for n in names])
    order_before = by_order.select(*group, order, *[over(n, f"_t_{n}", _before(group, order)).alias(f"_o_{n}") for n in names])
    inside_order = [*group, order]
    block_before = by_block.select(
        *inside_order, "_block", *[over(n, f"_s_{n}", _before(inside_order, "_block")).alias(f"_b_{n}") for n in names],
    ).join(order_before, inside_order)
    inside = _before([*inside_order, "_block"], position)
    out = rows.join(block_before, [*inside_order, "_block"]).withColumns(
        {n: joined(n, F.col(f"_o_{n}"), F.col(f"_b_{n}"), over(n, f"_v_{n}", inside)) for n in names}
    )
    return out.drop(*[f"_{k}_{n}" for n in names for k in "vob"])


def over_group(df: DataFrame, group: list[str], values: dict[str, Column], hot: list[int] | None = None) -> DataFrame:
    """Adds aggregates over all rows of the group. Groups in no hot place take one window, the others an aggregate and a join.
    Rows without a group must have been left out."""
    whole = Window.partitionBy(*group)
    return by_heat(
        df, group, hot, lambda rows: rows.withColumns({n: v.over(whole) for n, v in values.items()}),
        lambda rows: rows.drop(*values).join(rows.groupBy(*group).agg(*[v.alias(n) for n, v in values.items()]), group),
    )


def previous_values(
    df: DataFrame, group: list[str], order: str, position: str, columns: list[str], hot: list[int] | None = None
) -> DataFrame:
    """Adds `previous`, a struct of the columns on the row just before in (`order`, `position`) order; null on the first.

    One window or three levels as in `running_before`, so a hot group is never one window partition.
    """
    ordered = Window.partitionBy(*group).orderBy(order, position)

    def cool(rows: DataFrame) -> DataFrame:
        # A row without a position is passed over; an `order` value that has no other rows hides what lies before it. Such rows come
        # first, so the last row of an `order` value tells. This window also keeps the struct below out of the shuffle.
        next_is_here = F.lead(order).over(ordered).eqNullSafe(F.col(order)) & F.lead(F.lit(True)).over(ordered)
        rows = rows.withColumn("_last", ~F.coalesce(next_is_here, F.lit(False)))
        placed = F.col(position).isNotNull() & (F.col("_block").isNotNull() if "_block" in rows.columns else F.lit(True))
        now = F.when(placed | F.col("_last"), F.struct(F.when(placed, F.struct(*columns)).alias("row")))
        found = F.last(now, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))["row"]
        return with_block(_with_place(rows.withColumn("previous", found).drop("_last"), order, position), position)

    return by_heat(_known(df, group), group, hot, cool, lambda rows: _previous_levels(rows, group, order, position, columns))


def _previous_levels(df: DataFrame, group: list[str], order: str, position: str, columns: list[str]) -> DataFrame:
    rows = with_block(df, position).withColumn("_now", F.struct(*columns))
    inside_order = [*group, order]
    by_block = rows.groupBy(*inside_order, "_block").agg(F.max_by("_now", position).alias("_last"))
    by_order = by_block.groupBy(*inside_order).agg(F.max_by("_last", "_block").alias("_end"))
    order_before = by_order.select(
        *inside_order, F.lag("_end").over(Window.partitionBy(*group).orderBy(order)).alias("_order_prev")
    )
    block_prev = F.lag("_last").over(Window.partitionBy(*inside_order).orderBy("_block"))
    block_before = by_block.withColumn("_block_prev", block_prev).drop("_last").join(order_before, inside_order)
    inside = Window.partitionBy(*inside_order, "_block").orderBy(position)
    return (
        rows.join(block_before, [*inside_order, "_block"])
        .withColumn("previous", F.coalesce(F.lag("_now").over(inside), "_block_prev", "_order_prev"))
        .drop("_now", "_block_prev", "_order_prev")
    )


def last_known(df: DataFrame, group: list[str], position: str, value: Column, name: str) -> DataFrame:
    """The last non-null `value` at or before each row of the group, in `position` order.

    Blocks of positions pass on what they end with, so no window holds more than a block of rows or the blocks of one
    group.
    """
    rows = with_block(df, position).withColumn("_value", value)
    ends = rows.groupBy(*group, "_block").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(position))).alias("_end")
    )
    carried = ends.select(*group, "_block", F.last("_end", ignorenulls=True).over(_before(group, "_block")).alias("_carried"))
    inside = Window.partitionBy(*group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, [*group, "_block"])
        .withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_carried"))
        .drop("_block", "_value", "_carried")
    )


def inside_spans(points: DataFrame, spans: DataFrame, keys: list[str], day: str, start: str, end: str, name: str) -> DataFrame:
    """The distinct `keys` and `day` of `points` that lie in a span of the same keys, with `name` = true.

    A sweep: a span opens on its first day and closes the day after its last; a day is inside while more spans have opened
    than closed. Spans and points of a key meet as sums per day, never as pairs, so a window holds no more rows than the key has
    days. Spans without a start, or whose end lies before it, hold nothing; a null key is no key.
    """
    first, last = F.col(start), F.col(end)
    real = spans.filter(first <= last)
    opens = real.select(*keys, first.alias("_day"), F.lit(1).alias("_step"), F.lit(False).alias("_asked"))
    closes = real.select(*keys, F.date_add(last, 1).alias("_day"), F.lit(-1).alias("_step"), F.lit(False).alias("_asked"))
    asked = points.filter(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_day"), F.lit(0).alias("_step"), F.lit(True).alias("_asked"))
    days = opens.unionByName(closes).unionByName(asked).groupBy(*keys, "_day").agg(F.sum("_step").alias("_step"), F.max("_asked").alias("_asked"))
    so_far = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("_open", F.sum("_step").over(so_far)).filter("_asked AND _open > 0").select(
        *keys, F.col("_day").alias(day), F.lit(True).alias(name)
    )


def first_per_group(df: DataFrame, group: list[str], order_by: list[Column], limit: int = 1) -> DataFrame:
    """The first `limit` rows of each group; Spark keeps only that many per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit)
