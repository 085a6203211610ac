"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in P logical partitions of about ``rows_per_part`` (a hash of their values, so that a task run again
sees the same rows). A P x C matrix says how many rows of each partition go to each cell, a cell being one of
equal ranges of a shard's slots, about ``rows_per_cell`` long. Its rows are multivariate hypergeometric draws over
what the cells still need, so every cell gets its exact size and every assignment of rows to slots is equally
likely. It is drawn in two levels: the driver draws how many rows each of ``groups`` groups of partitions sends to
each cell, and a task per group deals those out over its own partitions, one matrix row after the other. Rows are
permuted inside their partition (rank by a seeded hash) and dealt to cells by the partition's cumulated counts: the runs
of ranks that go to one cell are cut into stretches of ``STRETCH`` ranks, and a row meets the runs of its own stretch, at
most STRETCH + 1 of them however many cells there are. They are exchanged and permuted again inside the cell.
P and C grow with the input; the driver holds groups x C numbers, a task C.

Defined cases: an empty table gives an empty table; equal rows take different slots, but share a partition; null
keys are hashed like any value; a column of the input named shard or slot gives way to the result, all others,
whatever their names, are carried as one value and come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MOST_URN = 10**9  # numpy draws from smaller urns
STRETCH = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, most_urn: int = MOST_URN) -> int:
    """How many of n draws without replacement are good, from an urn of any size.

    Keeping every item with chance n / total makes a uniform subset of random size; what it has too many or too
    few is drawn again out of the subset or its complement, a number of about the square root of n."""
    taken, sign = 0, 1
    while True:
        total = good + bad
        if n == 0 or good == 0:
            return taken
        if bad == 0:
            return taken + sign * n
        if total < most_urn:
            return taken + sign * int(rng.hypergeometric(good, bad, n))
        if 2 * n > total:  # the ones that stay
            taken, sign, n = taken + sign * good, -sign, total - n
        elif n <= 32:
            for left in range(n):
                hit = int(rng.integers(total - left)) < good
                good, taken = good - hit, taken + sign * hit
            return taken
        else:
            a, b = (int(rng.binomial(k, n / total)) for k in (good, bad))
            taken += sign * a
            if a + b > n:
                good, bad, n, sign = a, b, a + b - n, -sign
            else:
                good, bad, n = good - a, bad - b, n - a - b


def matrix_rows(counts: np.ndarray, sizes: np.ndarray, seed: int | tuple[int, ...] = 0, most_urn: int = MOST_URN) -> Iterator[np.ndarray]:
    """For each partition in turn, how many of its rows go to each cell; they sum to its count, over all partitions to sizes."""
    rng = np.random.default_rng(seed)
    left = sizes.astype(np.int64).copy()
    for n in counts:
        total, need = int(left.sum()), int(n)
        if need and total < most_urn:
            out = rng.multivariate_hypergeometric(left, need, method="marginals")
        else:
            out = np.zeros(len(sizes), np.int64)
            for j in range(len(sizes)):  # the marginal draws of one multivariate row
                if not need:
                    break
                total -= int(left[j])
                out[j] = hypergeometric(rng, int(left[j]), total, need, most_urn)
                need -= int(out[j])
        left -= out
        yield out


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int | tuple[int, ...] = 0, most_urn: int = MOST_URN) -> np.ndarray:
    """All rows of ``matrix_rows``."""
    rows = list(matrix_rows(counts, sizes, seed, most_urn))
    return np.stack(rows) if rows else np.zeros((0, len(sizes)), np.int64)


def runs(row: np.ndarray, stretch: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each stretch of a partition's ranks, from 0, the first ranks of the runs that lie in it and the runs' cells."""
    cells = np.flatnonzero(row)
    ends = np.cumsum(row[cells])
    starts = ends - row[cells]
    for at in range(-(-int(ends[-1]) // stretch) if len(ends) else 0):
        low = int(np.searchsorted(ends, at * stretch, "right"))
        high = int(np.searchsorted(starts, (at + 1) * stretch, "left"))
        yield at, starts[low:high], cells[low:high]


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, key: list[str] | None = None, rows_per_cell: int = 1 << 16, rows_per_part: int = 1 << 18, groups: int = 64, most_urn: int = MOST_URN) -> DataFrame:
    """The rows with shard (0 to shards-1, counts at most one apart) and slot (gapless from 0 in each shard)."""
    key = key or df.columns
    own = [c for c in df.columns if c not in ("shard", "slot")]
    # hashes of the row's values, kept since its columns may give way; ties are equal rows, whose order doesn't matter
    mark = lambda n: F.xxhash64(F.lit(seed * 3 + n), *[F.col(f"`{c}`") for c in key])
    rows = df.agg(F.count("*")).first()[0]
    parts = max(groups, -(-rows // rows_per_part))
    splits = max(1, -(-rows // (shards * rows_per_cell)))
    src = df.select(F.struct(*[f"`{c}`" for c in own]).alias("row"), F.pmod(mark(0), F.lit(parts)).alias("part"), mark(1).alias("h1"), mark(2).alias("h2"))
    ties = [F.col("row").getField(c) for c in key if c in own]
    grouped = src.groupBy("part").agg(F.count("*").alias("n")).select((F.col("part") % groups).alias("g"), F.struct("part", "n").alias("x"))
    counted = cut(grouped.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("x")))  # the partitions of a group: parts / groups
    totals = np.zeros(groups, np.int64)
    for r in counted.select("g", F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"])).collect():  # a number per group
        totals[r[0]] = r[1]
    shard_sizes = np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)
    sizes = np.stack([shard_sizes // splits + (i < shard_sizes % splits) for i in range(splits)], 1)
    of_group = communication_matrix(totals, sizes.ravel(), seed, most_urn)
    spark = df.sparkSession
    first = spark.createDataFrame([(g, of_group[g].tolist()) for g in range(groups) if totals[g]], "g long, cells array<long>")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, x, cells in zip(frame["g"], frame["x"], frame["cells"]):
                drawn = matrix_rows(np.array([r["n"] for r in x]), np.asarray(cells), (seed, int(g) + 1), most_urn)
                for part, row in zip([r["part"] for r in x], drawn):
                    found = list(runs(row))
                    yield pd.DataFrame({"part": part, "stretch": [f[0] for f in found], "starts": [f[1] for f in found], "cells": [f[2] for f in found]})

    plan = counted.join(first, "g").mapInPandas(deal, "part long, stretch long, starts array<long>, cells array<long>")
    local = Window.partitionBy("part").orderBy("h1", *ties)
    ranked = src.withColumn("rank", F.row_number().over(local) - 1).withColumn("stretch", F.floor(F.col("rank") / STRETCH))
    run = F.size(F.filter("starts", lambda s: s <= F.col("rank")))
    dealt = ranked.join(plan, ["part", "stretch"]).select("row", "h2", F.element_at("cells", run).alias("to"))
    dealt = dealt.select("row", "h2", F.floor(F.col("to") / splits).cast("int").alias("shard"), (F.col("to") % splits).alias("cell"))
    again = Window.partitionBy("shard", "cell").orderBy("h2", *ties)
    # a shard's first rows % splits cells have one slot more
    in_shard = F.lit(rows // shards) + (F.col("shard") < rows % shards).cast("long")
    each, more = F.floor(in_shard / splits), in_shard % splits
    start = F.col("cell") * each + F.least(F.col("cell"), more)
    placed = dealt.select("row", "shard", (start + F.row_number().over(again) - 1).cast("long").alias("slot"))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in own], "shard", "slot")


def shard_rows(documents: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. Texts are digested where they are read and aren't moved."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = documents.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shuffle_into_shards(thin, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
