"""The corpus operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import AUDIT_SQL, interactions
from .bestfit import pack_best_fit
from .common import table
from .html import extract
from .importance import IMPORTANCE_SQL, resample
from .kmtree import nearest_to_hundredths
from .language import languages
from .media import avi_digest
from .packing import pack
from .quality import quality_scores
from .repeats import removed_repeats
from .sharding import shard_rows
from .simhash import near_duplicates
from .spm import sp_digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op11_filter_audit": AUDIT_SQL, "op13_importance": IMPORTANCE_SQL}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


@query("op1_kmeans_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_to_hundredths(table(spark, sf_dir, "embeddings"))


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_digest(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


@query("op5_repeats")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(table(spark, sf_dir, "documents"))


@query("op6_html")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@query("op10_media")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_digest(table(spark, sf_dir, "documents"))


@query("op11_filter_audit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_best_fit")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


@query("op13_importance")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
