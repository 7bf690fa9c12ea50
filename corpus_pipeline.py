"""A corpus pipeline: five stages, each written as Parquet and read by the next.

Toxic documents go; one document of each group of near copies stays (five-word
shingles, similarity 0.8 or more); documents that hold benchmark passages go;
secrets are masked; what is left is packed into windows of 4096 tokens.

All stages: a null text is an empty text, and stays null where the row stays; texts of
any length are taken whole; an empty table stays empty; further columns go along up to
packing, whatever their names.  Rows without a doc_id are not judged, so they pass the
filters as they are, and end at packing, which has nothing to call them by.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vellumlake.llm.common import only, remove, shared_folder
from vellumlake.llm.decontamination import contaminated
from vellumlake.llm.ngram_join import representatives
from vellumlake.llm.packing import packed, word_bpe
from vellumlake.llm.secrets import masked
from vellumlake.llm.toxicity import clean


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic; of rows that repeat a doc_id all go if one is predicted so."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; empty texts are copies of nothing; rows that repeat that doc_id stay with it."""
    return representatives(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item, at most a fifth of its words changed."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id")
    return only(docs, found, "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every reported secret masked, n_chars counted anew; weak parts count within 200 characters of a complementary part in their scope."""
    return masked(docs)


def into_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens; rows that repeat are packed one by one."""
    return packed(docs, word_bpe())


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("packing", into_windows),
]

#: Tokens and learned scores are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what lies between them is written to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")  # its rows have gone on
        before = name
    return docs
