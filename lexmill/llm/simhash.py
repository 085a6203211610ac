"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are computed where texts are read; only (id, fingerprint) goes on. Distinct fingerprints are
routed by pigeonhole: two that differ in at most two of 64 bits agree in two of four 16-bit blocks at least,
so they meet under one of six keys. A key with more than ``most`` fingerprints is split by three further keys
(of the other 32 bits, cut in three, one part must agree as well), which loses no pair. Under its key each
group is an index: fingerprints sorted by Gray rank are the leaves; an upper node keeps the bits that all of
its leaves share (mask and pattern). The self-join walks pairs of nodes from the top and drops a pair of
groups when their shared bits already differ in more than the radius. Each task returns links of its groups
to the smallest document found so far, never all pairs; components are then joined over the links by
alternating large-star and small-star steps, cut by checkpoints.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; rows with a null id
get their fingerprint's component but name none; equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected as components
from .common import cut, small_batches

RADIUS = 2
FANOUT = 4
BITS = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        marks = [h(b" ".join(words), 42)]
    elif shingle == 3:
        marks = [h(b"%b %b %b" % w, 42) for w in zip(words, words[1:], words[2:])]
    else:
        marks = [h(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)]
    return folded(marks)


def folded(marks: list[int] | np.ndarray) -> int:
    """The bits that more than half of some 64-bit hashes have."""
    n = len(marks)
    bits = np.unpackbits(np.array(marks, ">u8").view(np.uint8).reshape(n, 8), axis=1)
    # summed in runs of 255, which a byte holds
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 255):
        ones += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            fp = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return src.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchies over groups of fingerprints: fp sorted by (group, Gray rank)."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        full = np.full(len(fp), ~np.uint64(0))
        # levels from the leaves: mask of shared bits, pattern, first child (with an end), group
        self.levels = [(full, fp, None, group)]
        while True:
            mask, pattern, _, g = self.levels[-1]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            if len(first) == len(g):
                break
            place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
            heads = np.flatnonzero(place % FANOUT == 0)
            both = np.bitwise_and.reduceat(pattern, heads)
            some = np.bitwise_or.reduceat(pattern, heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~(both ^ some)
            self.levels.append((shared, both & shared, np.append(heads, len(g)), g[heads]))

    def close_pairs(self, radius: int = RADIUS, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves of one group within the radius, in blocks."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        stack = [(top, roots[i : i + at_once], roots[i : i + at_once]) for i in range(0, len(roots), at_once)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                yield a[a != b], b[a != b]
                continue
            heads = self.levels[level][2]
            mask, pattern = self.levels[level - 1][:2]
            out_a, out_b = [], []
            for i in range(FANOUT):
                for j in range(FANOUT):
                    x, y = heads[a] + i, heads[b] + j
                    ok = (x < heads[a + 1]) & (y < heads[b + 1]) & ((a != b) | (x <= y))
                    x, y = x[ok], y[ok]
                    ok = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= radius
                    out_a.append(x[ok])
                    out_b.append(y[ok])
            x, y = np.concatenate(out_a), np.concatenate(out_b)
            stack += [(level - 1, x[i : i + at_once], y[i : i + at_once]) for i in range(0, len(x), at_once)]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by the smaller place, vectorised."""
    while len(a):
        ra, rb = parent[a], parent[b]
        while True:
            na, nb = parent[ra], parent[rb]
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) of groups of equal key; key is sorted."""
    # groups of one have no pair
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    size = np.diff(np.concatenate([[0], change, [len(key)]]))
    group = np.repeat(np.arange(len(size)), size)
    many = np.repeat(size > 1, size)
    fp, node, group = fp[many], node[many], group[many]
    if not len(fp):
        return node, node
    order = np.lexsort((gray_rank(fp), group))
    fp, node, group = fp[order], node[order], group[order]
    rank = np.argsort(node, kind="stable")  # places by node, so that the root is the smallest node
    place = np.empty(len(node), np.int64)
    place[rank] = np.arange(len(node))
    by_node = node[rank]
    # a node stands once per key it lies under; each standing is its own place
    parent = np.arange(len(node))
    for a, b in GrayIndex(fp, group).close_pairs(radius):
        _merge(parent, place[a], place[b])
    while (parent != parent[parent]).any():
        parent = parent[parent]
    linked = by_node != by_node[parent]
    return by_node[linked], by_node[parent[linked]]


def close_links(nodes: DataFrame, most: int = 4096, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a > b, between nodes (node, fp) of distinct fingerprints within two bits; connected exactly as all close pairs are."""
    if radius > 2:
        raise ValueError("the keys hold for radius 2 at most")
    block = lambda i, w=16: F.shiftrightunsigned("fp", 16 * i).bitwiseAND((1 << w) - 1)
    choices = list(combinations(range(4), 2))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), (F.shiftleft(block(i), 16) + block(j)).alias("key")) for t, (i, j) in enumerate(choices)])
    routed = nodes.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.t", "k.key")
    size = routed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    routed = routed.join(size, ["t", "key"])
    # the other two blocks, of which one of three parts must agree in a pair
    rest = F.lit(None).cast("long")
    for t, pair in enumerate(choices):
        i, j = [k for k in range(4) if k not in pair]
        rest = F.when(F.col("t") == t, F.shiftleft(block(i), 16) + block(j)).otherwise(rest)
    cuts = [(0, 11), (11, 11), (22, 10)]
    parts = F.array(*[F.shiftleft(F.shiftrightunsigned("rest", s).bitwiseAND((1 << w) - 1) + 1, 2) + i for i, (s, w) in enumerate(cuts)])
    routed = routed.withColumn("rest", rest).withColumn("sub", F.explode(F.when(F.col("n") > most, parts).otherwise(F.array(F.lit(0).cast("long")))))
    routed = routed.select(F.xxhash64("t", "key", "sub").alias("k"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _links(rows[0], rows[1].view(np.uint64), rows[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            held.append(rows)
            count += rows.shape[1]
            if count >= 1 << 18:
                rows = np.concatenate(held, 1)
                end = int(np.searchsorted(rows[0], rows[0, -1], "left"))  # the last group may go on
                if end:
                    yield emit(rows[:, :end])
                held, count = [rows[:, end:]], rows.shape[1] - end
        if count:
            yield emit(np.concatenate(held, 1))

    # a hash of the key only groups: fingerprints of two keys that meet by chance are still compared exactly
    return routed.repartition("k").sortWithinPartitions("k").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 4096) -> DataFrame:
    """Rows (id, fingerprint, component_id) of every row; ids are integers, component_id is the smallest reachable."""
    own = cut(fingerprints(df, id_col, text_col, shingle))
    nodes = own.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").cast("long").alias("node"))
    nodes = cut(nodes)
    root = components(close_links(nodes, most))
    named = nodes.join(root, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = own.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
