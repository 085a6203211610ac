"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Distinct texts (md5) are nodes. Where texts are read, each gets the SimHash of its shingles; the Gray-order index of
``simhash`` joins fingerprints within two bits, and what it joins shares one key. Copies edited further are beyond two bits
(texts of similarity 0.8 differ in about 10 of 64), so each text has ``bands`` further keys, a key being a hash of ``rows``
MinHash values; two texts of similarity s share one of these with probability 1 - (1 - s^rows)^bands, 0.9996 at 0.8 and
1 - 3e-8 at 0.9. Candidates of either kind are verified exactly on the shingle sets, in two rounds. First each text of a key meets
the least one there, which settles keys whose texts are all close to it. Where some aren't (copies of one text with
ever other edits), all texts of the key are compared in blocks of about ``BLOCK`` texts
and ``BLOCK_MARKS`` shingles: a task counts the common shingles of
all of its texts by a product of matrices and gives back, for each text, only the least one of its part. Any two
close texts of a key are thus in one component. Components are joined as in ``simhash``.

An index of 64-bit fingerprints alone can't serve here: a radius that holds nearly all texts of similarity 0.8 (18)
would hold most pairs of the corpus. Fingerprints are of the distinct shingles, so that one repeated phrase doesn't make texts alike.

Defined cases: words are split at white space, in ASCII lower case; a text of five words or fewer is one shingle;
null, empty and blank texts are alike; rows with a null id are no nodes; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected as components
from .common import cut, release, small_batches
from .simhash import close_links, folded

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 20, 5
BLOCK, BLOCK_MARKS = 1024, 1 << 20
STRIP = 128  # rows of the matrices of a block that are worked on at once


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.array([h(b" ".join(words[i : i + shingle]), 42) for i in range(n)], np.uint64))


def band_keys(marks: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key a band from the least values of bands * rows hashes of the marks."""
    draws = np.random.default_rng(5).integers(0, 1 << 63, (2, bands * rows), np.uint64)
    factor, mask = draws[0] | np.uint64(1), draws[1]
    least = np.full(bands * rows, ~np.uint64(0))
    for i in range(0, len(marks), 1024):
        part = (marks[i : i + 1024, None] ^ mask) * factor
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(0))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with ok: whether their sets are close enough."""
    both = pairs.join(sets.select(F.col("f").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("f").alias("b"), F.col("s").alias("sb")), "b")
    met = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("m"))
    return cut(met.select("a", "b", ((F.col("m") == 0) | (F.col("n") >= least * (F.col("m") - F.col("n")))).alias("ok")))


def close_parts(sets: list[np.ndarray], least: float = LEAST, at_once: int = 2048) -> np.ndarray:
    """For each set the first one of its part, parts being joined by pairs that are close enough."""
    n, size = len(sets), np.array([len(x) for x in sets], np.float64)
    marks, row = np.concatenate([np.zeros(0, np.int64), *sets]), np.repeat(np.arange(n), size.astype(np.int64))
    _, mark, times = np.unique(marks, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)  # the others are in no pair
    number = np.full(len(times), -1)
    number[common] = np.arange(len(common))
    mark = number[mark]
    order = np.argsort(mark, kind="stable")
    mark, row = mark[order], row[order]
    met, strips = np.zeros((n, n), np.int32), [slice(i, i + STRIP) for i in range(0, n, STRIP)]
    for start in range(0, len(common), at_once):
        part = slice(*np.searchsorted(mark, [start, start + at_once]))
        has = np.zeros((n, min(at_once, len(common) - start)), np.float32)
        has[row[part], mark[part] - start] = 1
        for r in strips:
            met[r] += (has[r] @ has.T).astype(np.int32)
        del has
    near = np.eye(n, dtype=bool)
    for r in strips:
        both = size[r, None] + size
        near[r] |= (both == 0) | (met[r] >= least * (both - met[r]))
    del met
    label = np.arange(n)
    while True:
        low = np.concatenate([np.where(near[r], label, n).min(1) for r in strips]) if n else label
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows to keep, (id, f): of each component of near copies the smallest id and, of its texts, the least md5 f."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            marks = [shingles(x) for x in b.column(2).to_pylist()]
            found = [pa.array([band_keys(x) for x in marks], pa.list_(pa.int64())), pa.array([len(x) for x in marks], pa.int64()), pa.array(np.array([folded(x) if len(x) else 0 for x in marks], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], names=["id", "f", "keys", "size", "fp"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x).view(np.int64) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["f", "s"])

    kind = dict(df.dtypes)[id_col]
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), digest(text_col).alias("f"), F.col(f"`{text_col}`").alias("text"))
    marked = rows.mapInArrow(keys, f"id {kind}, f string, keys array<long>, size long, fp long")
    nodes = cut(marked.groupBy("f").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    prints = cut(nodes.select("fp").distinct())
    joined = components(close_links(prints.select(F.col("fp").alias("node"), "fp"))).withColumnRenamed("node", "fp")
    by_print = nodes.select("f", "size", "fp").join(joined, "fp", "left").select("f", "size", F.lit(-1).alias("band"), F.coalesce("root", "fp").alias("key"))
    routed = nodes.select("f", "size", F.posexplode("keys").alias("band", "key")).unionByName(by_print)
    met = routed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("marks"), F.min("f").alias("first")).where("n > 1")
    routed = cut(routed.drop("size").join(met, ["band", "key"]))
    pairs = cut(routed.where("f <> first").select(F.col("f").alias("a"), F.col("first").alias("b")).distinct())
    involved = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "f").join(nodes.select("f", "id"), "f")
    texts = rows.join(involved, ["id", "f"], "left_semi").dropDuplicates(["f"]).select("f", "text")
    sets = cut(texts.mapInArrow(sets_of, "f string, s array<long>"))
    first = _verified(pairs, sets, least)
    apart = first.where("not ok").select(F.col("a").alias("f"), F.col("b").alias("first"))
    mixed = routed.join(apart, ["f", "first"], "left_semi").select("band", "key").distinct()
    # a key's texts in blocks; each pair of blocks meets once
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("marks") / BLOCK_MARKS), F.lit(1)).cast("int")
    members = routed.join(mixed, ["band", "key"], "left_semi").select("band", "key", "f", blocks.alias("blocks"), F.pmod(F.xxhash64("f"), blocks).cast("int").alias("own"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", "key", "f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "f")

    def compare(t: pa.Table) -> pa.Table:
        release()
        t = t.sort_by("f")
        part = close_parts([np.asarray(x) for x in t.column("s").combine_chunks().to_numpy(zero_copy_only=False)], least)
        names = t.column("f").to_pylist()
        found = [(names[i], names[p]) for i, p in enumerate(part.tolist()) if p != i]
        return pa.table([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["a", "b"])

    again = members.groupBy("band", "key", "i", "j").applyInArrow(compare, "a string, b string")
    links = first.where("ok").select("a", "b").union(again)
    root = components(links)
    named = nodes.select("f", "id").join(root, nodes["f"] == root["node"], "left").select(F.coalesce("root", "f").alias("root"), F.struct("id", "f").alias("x"))
    return named.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.id").alias(id_col), F.col("x.f").alias("f"))


def digest(text_col: str):
    """What tells texts apart; null is as an empty text."""
    return F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
