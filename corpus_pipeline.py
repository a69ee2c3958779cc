"""A training-data pipeline over ``documents``: five stages, each of which works
on everything that its predecessor kept.

Defined results, stage by stage, are those of the operators: rows without text don't
pass the quality rules, so they end there; a null ``doc_id`` is judged by quality and
toxicity, stays as it is in both dedup stages and is packed; rows that repeat an id and
its text are one document from near-dedup on; very long texts are worked on whole; other
columns are kept up to packing, whatever their names; an empty table gives an empty
result. The last stage returns the packed pieces (shard, bin, doc_id, piece,
start_token, n_tokens); their texts are the rows of the stage before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.packing import pack_documents
from bitloom.llm.quality import quality_filter
from bitloom.llm.simhash import keep_one_of_each_group
from bitloom.llm.suffix import remove_repeated_passages
from bitloom.llm.toxicity import toxicity_filter
from bitloom.session import materialize, prepare, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_filter(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return remove_repeated_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: Trained models, fingerprints and bin packing can't be stated in SQL; the
#: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every stage's result is written as
    Parquet in the shared folder and read again by the next one."""
    prepare(spark)
    df = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k + 1 < len(STAGES):
            df = materialize(df, f"pipeline-{k}")
    return df
