"""Writers: one output per taxability group, and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import beside
from ..functions.text import csv_safe
from ..operators.controls import record_digest, table_digest

RUN_COLUMNS = ["run_ref", "ran_at", "ran_by", "fiscal_year", "fiscal_period", "control_status", "measures", "mapping", "inputs"]


def with_output_group(enriched: DataFrame) -> DataFrame:
    """The output each kept row goes to: its taxability, or New Vendors."""
    group = F.when(F.col("new_vendor"), "New Vendors").otherwise(F.coalesce(F.nullif(F.trim("taxability"), F.lit("")), F.lit("Unclassified")))
    return enriched.withColumn("output_group", group)


def write_groups(enriched: DataFrame, removed: DataFrame, path: str) -> None:
    """One folder per output group and one for the removed rows. Files split by size, so a hot group is many files."""
    with_output_group(enriched).write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("output_group").parquet(f"{path}/kept")
    removed.write.mode("overwrite").parquet(f"{path}/removed")


def run_record(metrics: DataFrame, run_ref: str, ran_at: str, ran_by: str, year: int, period: int, status: str, mapping: str, inputs: DataFrame) -> DataFrame:
    """One row for the run log with its digest. A run without a PASS or FAIL verdict is refused. `inputs` (role, sha256) may be
    files or whole tables (`proved`); the record holds how many there are and the digest of their list, which goes beside
    the log (`append_run`), so a run over any number of inputs is one small row."""
    if status not in ("PASS", "FAIL"):
        raise ValueError("The run has no PASS/FAIL control status, so it cannot be recorded.")
    files = table_digest(inputs, "inputs", ["role", "sha256"]).select(F.to_json(F.struct(F.col("n_rows").alias("n"), "digest")).alias("inputs"))
    row = metrics.select(F.to_json(F.struct("*")).alias("measures")).transform(beside, files).select(
        F.lit(run_ref).alias("run_ref"), F.lit(ran_at).alias("ran_at"), F.lit(ran_by or "Unverified").alias("ran_by"), F.lit(year).alias("fiscal_year"),
        F.lit(period).alias("fiscal_period"), F.lit(status).alias("control_status"), "measures", F.lit(mapping).alias("mapping"), "inputs",
    )
    return row.withColumn("digest", record_digest(RUN_COLUMNS))


def proved(tables: dict[str, DataFrame]) -> DataFrame:
    """(role, sha256) of whole tables, by their rows in any order."""
    out = None
    for role, table in tables.items():
        own = table_digest(table, role).select(F.col("table_name").alias("role"), F.col("digest").alias("sha256"))
        out = own if out is None else out.unionByName(own)
    return out


def append_run(record: DataFrame, path: str, inputs: DataFrame | None = None) -> None:
    """Adds a record to the log, and its inputs under its run to the folder beside it."""
    record.write.mode("append").parquet(path)
    if inputs is not None:
        run = record.agg(F.max("run_ref").alias("run_ref"))
        inputs.transform(beside, run).write.mode("append").parquet(f"{path.rstrip('/')}-inputs")


def inputs_changed(record: DataFrame, inputs: DataFrame) -> DataFrame:
    """The record where `inputs` are not the ones it was made from."""
    now = table_digest(inputs, "inputs", ["role", "sha256"]).select(F.to_json(F.struct(F.col("n_rows").alias("n"), "digest")).alias("_now"))
    return record.transform(beside, now).filter("inputs <> _now").drop("_now")


def log_csv(records: DataFrame) -> DataFrame:
    """The run log with every text cell safe for a spreadsheet, newest first."""
    return records.select(*[csv_safe(F.col(c).cast("string")).alias(c) for c in records.columns]).orderBy(F.desc("ran_at"))
