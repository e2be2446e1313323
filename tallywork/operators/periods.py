"""Closed periods: sequence, roll-forward equality, totals, versions, close and reopen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import first_per_group
from .fifo import QTY_TOLERANCE, VALUE_TOLERANCE

PERIODS_PER_YEAR = 13


def ordinal(year="fiscal_year", period="period") -> Column:
    return F.col(year) * PERIODS_PER_YEAR + F.col(period)


def period_key(year="fiscal_year", period="period") -> Column:
    return F.format_string("FY%d-P%02d", F.col(year), F.col(period))


def sequence_breaks(closures: DataFrame, scope: list[str]) -> DataFrame:
    """Closed periods that do not follow the one before them. Partitions hold the closed periods of one scope."""
    window = Window.partitionBy(*scope).orderBy("ordinal")
    linked = closures.filter("status = 'closed'").withColumn("ordinal", ordinal()).withColumn(
        "previous", F.lag("ordinal").over(window)
    )
    return linked.filter("previous IS NOT NULL AND ordinal <> previous + 1")


def latest_per(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key."""
    return first_per_group(df, keys, [F.col(version).desc()]).drop("_rank")


def latest_templates(versions: DataFrame, templates: DataFrame) -> DataFrame:
    """Newest version of every template that is not archived."""
    live = templates.filter("archived_at IS NULL").select("template_id", "name")
    return latest_per(versions, ["template_id"], "version").join(live, "template_id")


def current_layers(layers: DataFrame, closures: DataFrame) -> DataFrame:
    """Ending layers of the latest closed period."""
    last = closures.filter("status = 'closed'").agg(F.max(ordinal()).alias("last"))
    return (
        layers.filter("layer_kind = 'ending'").withColumn("ordinal", ordinal()).join(F.broadcast(last), F.col("ordinal") == F.col("last"))
        .drop("ordinal", "last")
    )


def roll_forward_breaks(layers: DataFrame) -> DataFrame:
    """Layers that differ between one period's ending and the next period's beginning, both ways."""
    columns = ["ordinal", "product", "seq", "qty", "total_value"]
    placed = layers.withColumn("ordinal", ordinal())
    known = placed.select("ordinal").distinct()
    ending = placed.filter("layer_kind = 'ending'").withColumn("ordinal", F.col("ordinal") + 1).join(known, "ordinal", "left_semi")
    prior = placed.select((F.col("ordinal") + 1).alias("ordinal")).distinct()
    beginning = placed.filter("layer_kind = 'beginning'").join(prior, "ordinal", "left_semi")
    left, right = ending.select(*columns), beginning.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("ending only")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("beginning only"))
    )


def total_breaks(layers: DataFrame, closures: DataFrame) -> DataFrame:
    """Closures whose ending layers do not add up to the recorded totals within tolerance."""
    sums = layers.filter("layer_kind = 'ending'").groupBy("fiscal_year", "period").agg(
        F.sum("qty").alias("layer_qty"), F.sum("total_value").alias("layer_value")
    )
    joined = closures.join(sums, ["fiscal_year", "period"], "left").fillna(0.0, ["layer_qty", "layer_value"])
    off = (F.abs(F.col("layer_qty") - F.col("ending_qty")) > QTY_TOLERANCE) | (
        F.abs(F.col("layer_value") - F.col("ending_value")) > VALUE_TOLERANCE
    )
    return joined.filter(off)


def next_period(year: int, period: int) -> tuple[int, int]:
    return (year + 1, 1) if period == PERIODS_PER_YEAR else (year, period + 1)


def close_period(path: str, year: int, period: int, beginning: DataFrame, ending: DataFrame, summary: DataFrame, receipts: DataFrame):
    """Write one closed period as its own partitions of four tables under `path`.

    Closes run in sequence: the period must follow the last closed one. The closure row is written last, so a close
    that failed half-way is not a closed period, and writing it again replaces its partitions.
    """
    spark = ending.sparkSession
    done = closures(spark, path)
    if done is not None:
        last = done.agg(F.max(ordinal()).alias("o")).first()["o"]
        if last is not None and year * PERIODS_PER_YEAR + period != last + 1:
            raise ValueError(f"FY{year}-P{period:02d} is out of sequence.")

    def put(df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{table}/fiscal_year={year}/period={period}")

    put(beginning.withColumn("layer_kind", F.lit("beginning")).unionByName(
        ending.withColumn("layer_kind", F.lit("ending")), allowMissingColumns=True), "layers")
    put(summary, "summary")
    put(receipts, "receipts")
    written = spark.read.parquet(f"{path}/layers/fiscal_year={year}/period={period}").filter("layer_kind = 'ending'")
    put(
        written.agg(
            F.coalesce(F.sum("qty"), F.lit(0.0)).alias("ending_qty"),
            F.coalesce(F.sum("total_value"), F.lit(0.0)).alias("ending_value"), F.lit("closed").alias("status"),
            F.current_timestamp().alias("closed_at"),
        ),
        "closures",
    )


def reopen_latest(spark, path: str, year: int, period: int) -> None:
    """Reopen the latest closed period: its closure row is superseded, so its layers and receipts no longer count."""
    last = closures(spark, path).agg(F.max(ordinal()).alias("o")).first()["o"]
    if last != year * PERIODS_PER_YEAR + period:
        raise ValueError("Only the latest closed period can be reopened safely.")
    row = closures(spark, path).filter((F.col("fiscal_year") == year) & (F.col("period") == period))
    held = spark.createDataFrame(row.withColumn("status", F.lit("reopened")).drop("fiscal_year", "period").limit(1).toPandas())
    held.write.mode("overwrite").parquet(f"{path}/closures/fiscal_year={year}/period={period}")


def closures(spark, path: str) -> DataFrame | None:
    """Closed periods under `path`, or None before the first close."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/closures")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(f"{path}/closures").filter("status = 'closed'")


def receipt_register(spark, path: str) -> DataFrame:
    """Receipts recognized by closed periods; reopening a period releases its receipts."""
    keep = closures(spark, path).select("fiscal_year", "period")
    return spark.read.parquet(f"{path}/receipts").join(F.broadcast(keep), ["fiscal_year", "period"], "left_semi")
