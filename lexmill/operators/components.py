"""Connected components, and dense numbers for rows, without one task that sees them all."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a temporary one serves only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexmill-"))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least number of each number's component: roots hook onto smaller ones, then every pointer is shortened to its root."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        apart = low != high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """Rows (node, root) of stars that join what each stretch of about ``chunk`` edges of a task joins; a root has a row as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            n = t.num_rows
            both = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks().dictionary_encode()
            order = pc.sort_indices(both.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at = rank[both.indices.to_numpy()]
            names = both.dictionary.take(pa.array(order))
            return pa.RecordBatch.from_arrays([names, names.take(pa.array(_labels(at[:n], at[n:], len(order))))], names=["node", "root"])

        held, rows = [], 0
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= chunk:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    kind = dict(edges.dtypes)["u"]
    return edges.mapInArrow(run, f"node {kind}, root {kind}")


def spread_join(rows: DataFrame, table: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """rows left-joined with a table of one row a key; keys that more than 1/share of the rows have, ``share`` at most, are broadcast."""
    n = rows.count()
    hot = cut(rows.groupBy(key).count().where(F.col("count") > max(1, n // share)).select(key))
    if hot.isEmpty():
        return rows.join(table, key, "left")
    often = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))  # share rows at most
    plain = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return plain.unionByName(rows.join(F.broadcast(hot), key, "left_semi").join(often, key, "left"))


def connected(links: DataFrame, alone: int = 1 << 20, chunk: int = 1 << 20, most_rounds: int = 40) -> DataFrame:
    """Rows (node, root) over links (a, b), of any ordered type: root is the smallest node of its component, and no node of its own.

    A round joins the links that lie together, a stretch of ``chunk`` of them at a time in the task that has them, and
    puts a star (node, root) in their place. A node that several stretches have then has as many rows as those, however
    many links it had: a hub's neighbours are nowhere brought together. Its roots are the links of a smaller graph,
    which is dealt by its smaller ends (the ends that many links have also by the other end) and goes the same way; one of at
    most ``alone`` links is one task's last stretch. Nodes then take the roots that their roots were given, from
    the last round back. Each round is a checkpoint; a table of any size needs a few."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found: list[DataFrame] = []
    for _ in range(most_rounds):
        roots = _contracted(edges, chunk).groupBy("node").agg(F.collect_set("root").alias("roots"))  # a root a stretch at most
        met = cut(roots.select("node", F.array_min("roots").alias("root"), "roots"))
        found.append(met.select("node", "root"))
        edges = met.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("root").alias("v")).where("u <> v").distinct()
        edges = cut(edges)
        left = edges.count()
        if not left:
            break
        if left <= alone:
            found.append(_contracted(edges.coalesce(1), alone + 1))
            break
        hot = F.broadcast(edges.groupBy("v").count().where(F.col("count") > max(1, left // 1000)).select("v", F.lit(True).alias("hot")))  # 1000 rows at most
        dealt = edges.join(hot, "v", "left").withColumn("deal", F.when(F.col("hot"), F.xxhash64("u")).otherwise(F.xxhash64("v")))
        edges = dealt.repartition("deal").select("u", "v")
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    out = found.pop()
    while found:
        up = found.pop()
        out = spread_join(up.withColumnRenamed("root", "mid"), out.select(F.col("node").alias("mid"), "root"), "mid").select("node", F.coalesce("root", "mid").alias("root"))
    return out.where("node <> root")


def dense_index(df: DataFrame, bucket: Column, order: list[Column | str], name: str = "idx", most_buckets: int = 4096) -> DataFrame:
    """Gapless numbers from 0 in the order (bucket, order): ranked inside buckets, then moved by the buckets' counts.

    bucket is an integer from 0 to most_buckets - 1; what is broadcast has a row a bucket at most."""
    with_bucket = df.withColumn("__b", bucket.cast("int"))
    counts = with_bucket.groupBy("__b").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    ranked = with_bucket.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    return ranked.join(F.broadcast(starts), "__b").withColumn(name, (F.col("__start") + F.col("__r") - 1).cast("long")).drop("__b", "__start", "__r")
