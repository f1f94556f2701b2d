"""The training-data pipeline: language identification, toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listingspark.llm.arrays import staged
from listingspark.llm.language import language_stage
from listingspark.llm.ngram_join import near_duplicate_stage
from listingspark.llm.packing import packing_stage
from listingspark.llm.suffix_dedup import repeats_stage
from listingspark.llm.toxicity import toxicity_stage

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeats_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the learnt stages nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
