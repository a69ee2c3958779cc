"""Few bytes with much work are dealt to many tasks."""

import numpy as np
from pyspark.sql import functions as F

from bitloom.operators import codecs
from bitloom.operators.documents import encode_documents, pack


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_pages_are_coded_by_many_tasks(spark):
    pages = [(k, 1, 8, 8, pack(np.eye(8, dtype=np.uint8))) for k in range(64)]
    df = spark.createDataFrame(pages, "sid bigint, page bigint, width bigint, height bigint, bits binary")
    assert tasks(encode_documents(df)) > 1


def test_integers_are_coded_by_many_tasks(spark, tmp_path):
    rows = [(k, 1, float(k), 2.0) for k in range(64)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tasks(codecs.integer_roundtrip(spark, str(tmp_path))) > 1
