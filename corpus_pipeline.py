"""From raw documents to padded training batches.

STAGES lists (name, function); every function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of documents.  ``run``
writes each stage's result as Parquet in the shared folder and rereads it as
the next stage's input.  The stages' decisions on null, empty and repeated rows
are those of their operators; extra columns pass through up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrahaz.llm.common import documents, written
from terrahaz.llm.length_buckets import pack
from terrahaz.llm.odd_sketch_dedup import one_of_each
from terrahaz.llm.phrase_index import clean_documents
from terrahaz.llm.subword_toxicity import harmless
from terrahaz.llm.surrogates import replace_pii


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return replace_pii(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# a trained classifier and keyed surrogates: not for SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
