"""Columns of the input that have the names which the pipeline's stages would use come back as they were."""

from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm.common import free_name

SF = "/root/testdata/sf0.001"
NAMES = ["__f", "f", "__text", "text_", "__score", "score", "Bits", "__lang", "f_", "key"]


def test_free_names():
    assert free_name("f", ["a"]) == "f" and free_name("f", ["F", "f_"]) == "f__"


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"mine {n}" for r in rows for n in NAMES), name
