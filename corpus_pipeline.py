"""From raw documents to packed training windows, a Parquet table after each stage.

1. quality: documents that the classifier scores under 0.3 go; it learns from the labelled rows among those given.
2. language: documents without a letter (``und``) go, and those that fit no learned language: more entropy a symbol
   than twice what 99.9 per cent of all labelled documents of the predicted language have; ``lang`` becomes the
   predicted language.
3. near_duplicates: of each component of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id
   stays, once; texts of one id that are no near copies all stay. Rows without an id stay.
4. repeats: passages of 50 bytes or more that a smaller doc_id has go from the texts, whole characters only;
   n_chars is counted anew, and documents of which nothing is left go.
5. packing: windows of at most 4096 tokens, one row a piece.

Columns beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import language as lang_id
from lexmill.llm import quality as quality_model
from lexmill.llm.common import ensure_checkpoint_dir, free_name, table
from lexmill.llm.near import digest, near_copies
from lexmill.llm.packing import pack
from lexmill.llm.repeats import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.learn(docs, table(spark, sf_dir, "labels"))
    out = free_name("score", docs.columns)
    scored = quality_model.score(docs, model, keep=docs.columns, out=out)
    return scored.where(F.col(out) >= quality_model.THRESHOLD).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.learn(docs)
    name, score, bits = (free_name(n, docs.columns) for n in ("found", "score", "bits"))
    found = lang_id.predict(docs, model, keep=docs.columns, out=(name, score, bits))
    found = found.where(lang_id.within(lang_id.entropy_bounds(docs, model), name, bits))
    return found.select(*[F.col(name).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = free_name("f", docs.columns)
    stay = near_copies(docs).select("doc_id", F.col("f").alias(mark))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(mark, digest("text"))
    named = named.join(stay, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = without_repeats(docs).where(F.length("text") > 0)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, "word_bpe_49k.json")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packing),
]

# SQL expresses neither the learned models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's table lies in the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
