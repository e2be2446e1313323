"""From raw documents to packed sequences; each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywork.llm import decontaminate, near_dedup, packing, quality, substring_dedup
from tallywork.runtime import cut, prepare_session


def _nested(docs: DataFrame) -> DataFrame:
    """Id, text, and all other columns in one nested column, which keeps them apart from an operator's own."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("_row"))


def _with_text(rows: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The columns of documents with another text, and its length where there is a column for it."""
    docs = rows.select("_row.*", text.alias("text"))
    return (docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs).select(*columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    prepare_session(spark)
    voters = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.classify(_nested(docs), voters, ("text", "_row")).where("predicted = 1")
    return kept.select("_row.*", "text").select(*docs.columns)


def near_duplicates_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Of repeated rows of an id one stays."""
    prepare_session(spark)
    kept = near_dedup.near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    kept = cut(kept, "kept")
    left = docs.join(kept, docs.doc_id.cast("long").eqNullSafe(kept["_id"]), "left_semi")
    return left if kept.where("_n > 1").isEmpty() else left.dropDuplicates(["doc_id", "text"])


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; a document that has none keeps its text as it is."""
    prepare_session(spark)
    out = substring_dedup.remove_repeats(_nested(docs), carry=("text", "_row"))
    return _with_text(out, F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text")), docs.columns)


def benchmark_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark."""
    prepare_session(spark)
    out = decontaminate.decontaminate(_nested(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ("_row",))
    return _with_text(out, F.col("clean_text"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences for training."""
    prepare_session(spark)
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality", quality_filter), ("near_dedup", near_duplicates_removed), ("substring_dedup", repeats_removed),
    ("decontamination", benchmark_removed), ("packing", packed),
]
ORACLE_SQL = None  # a classifier and bin packing are beyond SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result is that of the last."""
    prepare_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
