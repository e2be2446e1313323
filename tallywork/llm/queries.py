"""Registered queries of the operators for training text, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import prepare_session
from . import (
    alignment, decontaminate, language_id, lm_scoring, near_dedup, ogg, packing, perspectives, quality, sql, substring_dedup,
    topk, variants, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(twin: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare_session(spark)
            return fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if twin is not None:
            ORACLES[fn.__name__] = twin
        return fn

    return register


@query(sql.REPEATS)
def op1_substring_dedup(table) -> DataFrame:
    """Words of each document that stay once every repeated passage of 35 words or more is removed."""
    out = substring_dedup.remove_repeats(table("documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query(sql.NEAR)
def op5_minhash_near_dedup(table) -> DataFrame:
    """Near-duplicate groups of all documents at 0.75 on five-word shingles."""
    return near_dedup.near_duplicates(table("documents"))


@query(sql.LEAKS)
def op9_benchmark_decontamination(table) -> DataFrame:
    """Benchmark phrases in all documents."""
    out = decontaminate.decontaminate(table("documents"), table("benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query()
def op4_packing(table) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(table("documents"), public_tokenizers.path(packing.TOKENIZER))


@query()
def op7_quality_classifier(table) -> DataFrame:
    """Quality of every document by its labelled neighbours."""
    docs = table("documents")
    out = quality.classify(docs, quality.train(docs, table("labels")))
    return out.select("doc_id", (~quality.training_rows(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@query()
def op10_lm_scoring(table) -> DataFrame:
    """Log10 probability of every document under context-tree weighting, beside a word-count base."""
    return lm_scoring.score(table("documents"))


@query()
def op8_language_id(table) -> DataFrame:
    """Language of every document."""
    docs = table("documents")
    out = language_id.identify(docs, language_id.train(docs))
    held = (~language_id.training_rows(F.col("doc_id"))).alias("held_out")
    return out.select("doc_id", held, "lang_pred", "score", "bits_per_character", "rejected")


@query()
def op2_ogg_media(table) -> DataFrame:
    """Every document stored as an Ogg file, read back and described."""
    return ogg.decode(ogg.encode(table("documents")))


@query()
def op3_warc_derivatives(table) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derivatives(warc.responses(table("pages")))


@query(perspectives.SQL)
def op6_perspective_rotation(table) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    return perspectives.rotate(table("conversations"))


@query()
def op11_spelling_variants(table) -> DataFrame:
    """Words of all documents with the commoner word each is a variant of."""
    return variants.variants(table("documents"))


@query(sql.TOP)
def op12_exact_topk(table) -> DataFrame:
    """The 20 closest vectors to every twentieth one."""
    vectors = table("embeddings").selectExpr("vec_id id", "embedding vector")
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), 20, scale=64.0)


@query()
def op13_tokenizer_alignment(table) -> DataFrame:
    """Tokens of two vocabularies over every document: groups, overlaps, and how usual they are."""
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in (alignment.BYTE_LEVEL, alignment.PIECES)]
    out = alignment.align(table("documents"), *paths, digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")
