"""The corpus pipeline: quality filter, exact duplicates, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next
one. All stages but the last return the columns of docs. Stages are judged on their own input: quality drops rejected
documents only, the two dedup stages keep one document of each group (the largest id of equal texts, the least id of a
near-duplicate component), mixing repeats or leaves out documents, packing returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultloom.llm import exact_dedup, jaccard, mixing, packing, quality
from faultloom.llm.common import materialize, read_table
from faultloom.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts. Null texts are scored as empty, repeated rows alike; of an empty table nothing is kept."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased; null is empty): the largest id, one row where that is repeated."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the least id. Empty and null texts, and rows without id, all stay."""
    return jaccard.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times); a null source is one of its own, null texts have no words."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a repeated document is packed as often, a null text is its closing id alone."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality_filter", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, random rounding and token ids are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
