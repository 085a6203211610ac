"""Registry of the queries over the driver tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "split_integrity_exact",
    """
    WITH d AS (
      SELECT doc_id,
             CASE WHEN doc_id % 10 < 8 THEN 0 WHEN doc_id % 10 = 8 THEN 1 ELSE 2 END AS held,
             sha256(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS content_key
      FROM documents),
    c AS (SELECT content_key, max(held) AS assigned, count(DISTINCT held) AS n_splits FROM d GROUP BY 1)
    SELECT CASE d.held WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split,
           count(*) AS units,
           count(*) FILTER (WHERE d.held = c.assigned) AS kept,
           count(*) FILTER (WHERE d.held <> c.assigned) AS dropped,
           count(DISTINCT CASE WHEN c.n_splits > 1 THEN d.content_key END) AS cross_split_keys
    FROM d JOIN c USING (content_key) GROUP BY 1
    """,
)
def split_integrity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 10 < 8, 0).when(F.col("doc_id") % 10 == 8, 1).otherwise(2).alias("held"),
        F.sha2(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""), 256).alias("content_key"),
    )
    # one row per key and split before anything else is shuffled
    per = d.groupBy("content_key", "held").agg(F.count("*").alias("n"))
    c = per.groupBy("content_key").agg(F.max("held").alias("assigned"), F.count("*").alias("n_splits"))
    j = per.join(c, "content_key")
    return j.groupBy(
        F.when(F.col("held") == 0, "train").when(F.col("held") == 1, "valid").otherwise("test").alias("split")
    ).agg(
        F.sum("n").alias("units"),
        F.coalesce(F.sum(F.when(F.col("held") == F.col("assigned"), F.col("n"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("held") != F.col("assigned"), F.col("n"))), F.lit(0)).alias("dropped"),
        F.sum(F.when(F.col("n_splits") > 1, 1).otherwise(0)).cast("bigint").alias("cross_split_keys"),
    )


from . import queries_cases, queries_checks, queries_files, queries_more, queries_stats, queries_text  # noqa: E402,F401
