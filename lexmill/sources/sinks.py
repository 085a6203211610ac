"""Sinks: tables by split, JSON lines plain or compressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_by_split(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> None:
    """One folder a split; the format is Parquet or JSON."""
    df.write.mode("overwrite").partitionBy(split).format(fmt).save(path)


def write_json_lines(df: DataFrame, path: str, compressed: bool = False, most: int = 200_000) -> int:
    """Write JSON lines and return their number, which is counted as they are written. A compressed file is read by one task, so it has at most ``most`` lines."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    if compressed:
        out = out.option("maxRecordsPerFile", most)
    out.option("compression", "gzip" if compressed else "none").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]
