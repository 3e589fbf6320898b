"""The thin queries opN_<name>(spark, sf_dir) and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, grulm, jaccard, licenses, mixing, packing, pii, quality, vamana, warc
from .common import held_out, read_table


def tokenizer_file() -> str:
    """The public vocabulary; FAULTLOOM_TOKENIZER names another file of the same format."""
    if "FAULTLOOM_TOKENIZER" in os.environ:
        return os.environ["FAULTLOOM_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return vamana.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "class_id", "component_id")


def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_jaccard_join with the exact number of links of each row's class with other classes."""
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"), all_links=True).select("doc_id", "n_shingles", "class_id", "component_id", "n_links")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grulm.scores(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"), pii.train(pii.labelled_table(spark)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(read_table(spark, sf_dir, "documents"), licenses.train(licenses.templates_table(spark)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_graph_neighbours, op2_jaccard_join, op2_jaccard_links, op3_warc, op4_quality, op5_lm_scores, op6_pii, op7_exact_dedup, op8_packing, op9_licenses, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": jaccard.ORACLE, "op3_warc": warc.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE}
