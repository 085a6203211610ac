"""Queries over files that are written from the driver tables and read again by the sources; files lie in the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.components import ensure_checkpoint_dir
from .queries import query, table
from .sources import jsonl, sinks


def folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("s06_s08_k04_json_lines", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s06(spark, sf_dir):
    """Every document through compressed JSON lines."""
    d, path = table(spark, sf_dir, "documents"), folder(spark)
    sinks.write_json_lines(d, path, compressed=True)
    return jsonl.read_json_lines(spark, path, d.schema).select("record.*")


@query("s01_line_numbers", "SELECT count(*) AS n, count(*) AS numbers, 1::BIGINT AS first, count(*) AS last FROM documents")
def s01(spark, sf_dir):
    """Lines of a folder that each task wrote a file of: numbers are gapless over its files and their splits."""
    path = folder(spark)
    d = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    d.write.text(path)
    got = jsonl.lines(spark, path, across=True)
    return got.agg(F.count("*").alias("n"), F.count_distinct("line_no").alias("numbers"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def quarters(spark: SparkSession, sf_dir: str, value) -> str:
    """A folder a remainder of doc_id by four, rows in the order of doc_id through the files of a folder."""
    path = folder(spark)
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("part"), "doc_id", value.alias("value"))
    d.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(path)
    return path


def part_of():
    return F.regexp_extract("path", "part=(\\d)", 1).cast("long").alias("part")


@query("s01_numbers_of_ranges", "SELECT doc_id % 4 AS part, 2 * row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS line_no, doc_id FROM documents")
def s01_ranges(spark, sf_dir):
    """Every line's number and id, from ranges of 64 KB of each file, larger ones in large folders; every second line is blank."""
    path = quarters(spark, sf_dir, F.concat(F.to_json(F.struct("doc_id", "text")), F.lit("\n")))
    got = jsonl.lines(spark, path, split=1 << 16, across=True).where("value <> ''")
    return got.select(part_of(), "line_no", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


@query(
    "s09_digests_of_documents",
    """WITH v AS (SELECT doc_id % 4 AS part, doc_id, doc_id || ' ' || replace(text, chr(13), ' ') || chr(10) AS value FROM documents),
       f AS (SELECT part, string_agg(value, '' ORDER BY doc_id) AS whole FROM v GROUP BY part)
       SELECT part, strlen(whole)::BIGINT AS bytes, sha256(whole) AS sha256, (len(whole) - len(replace(whole, chr(10), '')))::BIGINT AS records FROM f""",
)
def s09_documents(spark, sf_dir):
    path = quarters(spark, sf_dir, F.concat_ws(" ", F.col("doc_id").cast("string"), F.translate("text", "\r", " ")))
    return jsonl.manifest(spark, [path], across=True).select(part_of(), "bytes", "sha256", "records")


@query("k01_split_folders", "SELECT o_orderstatus AS split, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def k01(spark, sf_dir):
    path = folder(spark)
    sinks.write_by_split(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "split"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query(
    "s12_malformed_lines",
    "SELECT count(*) FILTER (WHERE event_id % 5 <> 0) AS good, count(*) FILTER (WHERE event_id % 5 = 0) AS bad, (sum(event_id) FILTER (WHERE event_id % 5 <> 0))::BIGINT AS ids FROM events",
)
def s12(spark, sf_dir):
    """Every fifth line is cut off: quarantined with a null record."""
    path = folder(spark)
    whole = F.to_json(F.struct("event_id", "event_type"))
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, F.substr(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole).alias("value"))
    e.write.text(path)
    got = jsonl.read_json_lines(spark, path, "event_id long, event_type string", on_error="quarantine")
    return got.agg(F.count("record").alias("good"), F.count_if(F.col("record").isNull()).alias("bad"), F.sum("record.event_id").alias("ids"))


@query(
    "s02_flat_cases",
    """SELECT 'p' || o_custkey AS target_defendant, 'order ' || o_orderkey AS fact_raw, o_orderpriority AS charge, CASE WHEN o_orderkey % 3 = 0 THEN 'criminal_law:' || (o_orderkey % 400 + 1) END AS article,
              CASE WHEN o_orderkey % 11 = 0 THEN 'death' WHEN o_orderkey % 7 = 0 THEN 'life' ELSE 'fixed_term' END AS penalty_type,
              CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN (o_orderkey % 120 + 1)::DOUBLE END AS months, o_orderkey % 3 = 0 AS articles_available FROM orders""",
)
def s02(spark, sf_dir):
    """Every order as a line of the flat layout: one defendant, a charge with its suffix, articles for every third."""
    path, i = folder(spark), F.col("o_orderkey")
    term = F.struct((i % 11 == 0).alias("death_penalty"), (i % 7 == 0).alias("life_imprisonment"), (i % 120 + 1).cast("int").alias("imprisonment"))
    meta = F.struct(
        F.array(F.concat(F.lit("p"), "o_custkey")).alias("criminals"), F.array(F.concat("o_orderpriority", F.lit("罪"))).alias("accusation"),
        F.when(i % 3 == 0, F.array((i % 400 + 1).cast("string"))).alias("relevant_articles"), term.alias("term_of_imprisonment"),
    )
    sinks.write_json_lines(table(spark, sf_dir, "orders").select(F.concat(F.lit("order "), "o_orderkey").alias("fact"), meta.alias("meta")), path)
    got = jsonl.simple_cases(jsonl.read_json_lines(spark, path, jsonl.SIMPLE), "train")
    return got.select(
        "target_defendant", "fact_raw", F.get("charges", F.lit(0)).alias("charge"), F.get("conviction_articles", F.lit(0)).alias("article"), "penalty_type",
        F.col("imprisonment_months").cast("double").alias("months"), "articles_available",
    )
