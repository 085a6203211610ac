"""What sources hold: rows and bytes by split, folders' sizes, and the lexicon that a build recorded."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import manifest


def audit(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows (split, path, bytes, sha256, records)."""
    out = None
    for split, path in paths.items():
        part = manifest(spark, [path]).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out.select("split", "path", "bytes", "sha256", "records")


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (folder, files, bytes) of all files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def recorded_lexicon(spark: SparkSession, output: str, version: str = "v3") -> list[str]:
    """The charge lexicon of a build, if its redaction rules are of this version."""
    found = json.loads(spark.read.text(f"{output}/metadata").first()[0])["sanitizer"]
    if found["version"] != version:
        raise ValueError(f"the build's redaction is {found['version']}, not {version}")
    return found["charge_lexicon"]
