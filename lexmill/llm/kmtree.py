"""Approximate nearest neighbours by a hierarchical k-means tree searched best bin first.

A tree of k-means splits is fitted on a bounded sample (``max_sample`` vectors, smallest id hashes). Every
vector goes down to a leaf. A query goes through the tree with a priority queue of branches, nearest centre
first, and so has an order of leaves; the number of leaves that are visited is widened, on held-back sample
vectors, until their neighbours in the sample are found with ``recall``. Those are farther than neighbours
among all rows, so the calibration errs to the safe side. A query goes on past that number while the leaves
it has hold too few different ids.

Rows of a leaf, and the queries that visit it, are split into blocks of about ``block_rows`` by hashes of
their ids, so that a crowded leaf is many tasks; each pair of blocks returns a query's k nearest ids, in double
precision on the original vectors, and a ranking per query ends it. What is sent to tasks (tree, leaf counts)
is bounded by the sample.

Defined cases: null, zero and non-finite vectors, vectors of another length than most, and null ids take no
part; an id that occurs twice counts once, with its nearest vector; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Tree:
    def __init__(self, x: np.ndarray, branch: int = 8, leaf: int = 64, seed: int = 1):
        self.centres: list[np.ndarray] = []  # of each inner node
        self.children: list[np.ndarray] = []  # inner nodes as numbers, leaves as -1-leaf
        self.leaves = 0
        rng = np.random.default_rng(seed)

        def grow(rows: np.ndarray) -> int:
            if len(rows) <= leaf or len(np.unique(x[rows], axis=0)) < 2:
                self.leaves += 1
                return -self.leaves
            c = self._kmeans(x[rows], branch, rng)
            of = self._nearest(x[rows], c)
            used = np.unique(of)
            if len(used) < 2:
                self.leaves += 1
                return -self.leaves
            me = len(self.centres)
            self.centres.append(c[used])
            self.children.append(np.zeros(0, np.int64))
            self.children[me] = np.array([grow(rows[of == k]) for k in used])
            return me

        self.root = grow(np.arange(len(x)))

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c**2).sum(1)[None] - 2 * x @ c.T, 1)

    def _kmeans(self, x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        distinct = np.unique(x, axis=0)
        c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(rounds):
            of = self._nearest(x, c)
            c = np.stack([x[of == i].mean(0) if (of == i).any() else c[i] for i in range(len(c))])
        return c

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                of = self._nearest(x[rows], self.centres[node])
                stack += [(int(child), rows[of == i]) for i, child in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first search."""
        heap, n = [(0.0, 0, self.root)], 0
        while heap:
            _, _, node = heapq.heappop(heap)
            if node < 0:
                yield -1 - node
                continue
            for d, child in zip(((self.centres[node] - q) ** 2).sum(1).tolist(), self.children[node].tolist()):
                n += 1
                heapq.heappush(heap, (d, n, child))


def held_back(n: int, queries: int = 256, seed: int = 2) -> np.ndarray:
    """Which of n sample vectors the tree isn't fitted on: an eighth of them at most."""
    return np.random.default_rng(seed).choice(n, min(queries, n // 8), replace=False)


def calibrate(tree: Tree, x: np.ndarray, ids: np.ndarray, k: int, recall: float, own: np.ndarray) -> int:
    """Leaves to visit until the mean recall of sample neighbours, the nearest rows of other ids, reaches the aim for the rows own."""
    leaf, ranks = tree.leaf_of(x), []
    for i in own if len(own) else range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[ids == ids[i]] = np.inf
        near = np.argsort(d)
        near = near[np.sort(np.unique(ids[near], return_index=True)[1])]
        near = near[np.isfinite(d[near])][:k]
        place = {f: r for r, f in enumerate(tree.visit(x[i]))}
        ranks += [place[int(leaf[j])] for j in near]
    ranks, visits = np.array(ranks), 1
    while len(ranks) and visits < tree.leaves and (ranks < visits).mean() < recall:
        visits += 1
    return visits


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _nearest_rows(q: pa.Table, r: pa.Table, k: int, dim: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, x = r.column("id").to_numpy(), _matrix(r.column("v").combine_chunks(), dim).astype(np.float64)
    single = len(np.unique(ids)) == len(ids)
    out = []
    for qid, v in zip(q.column("query_id").to_pylist(), _matrix(q.column("v").combine_chunks(), dim).astype(np.float64)):
        d = np.sqrt(((x - v) ** 2).sum(1))
        d[ids == qid] = np.inf
        few, most = np.arange(len(d)), k
        while len(d) > 4 * most:
            near = np.flatnonzero(d <= np.partition(d, most)[most])  # ties at the edge stay in
            if single or len(np.unique(ids[near])) >= k:
                few = near
                break
            most *= 4  # repeated ids fill the places
        few = few[np.lexsort((ids[few], d[few]))]
        few = few[np.isfinite(d[few])]
        if not single:  # the nearest row of each id
            few = few[np.sort(np.unique(ids[few], return_index=True)[1])]
        few = few[:k]
        out.append((np.full(len(few), qid, np.int64), ids[few], d[few]))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, max_sample: int = 20000, leaf: int = 64, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, id, score (Euclidean distance) of each query's k nearest rows that the search finds; a query's own id is no candidate."""
    v = F.col(vector_col)
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(sound(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    asked = queries.where(fit).select(F.col(id_col).cast("long").alias("query_id"), v.alias("v")).groupBy("query_id").agg(F.min("v").alias("v"))
    out = f"query_id long, rank int, `{id_col}` long, score double"
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], out)
    dim = common[0]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("id", "v").toArrow()
    x = _matrix(sample.column("v").combine_chunks(), dim).astype(np.float64)
    own = held_back(len(x))
    tree = Tree(np.delete(x, own, 0), leaf=leaf)
    visits = calibrate(tree, x, sample.column("id").to_numpy(), k, recall, own)
    kind = dict(vectors.dtypes)[vector_col]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = tree.leaf_of(_matrix(b.column(1), dim).astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at)], names=["id", "v", "leaf"])

    placed = rows.mapInArrow(place, f"id long, v {kind}, leaf long")
    count, named = np.zeros((2, tree.leaves), np.int64)  # rows, and ids of which this is the first leaf, so that none counts twice
    met = placed.groupBy("id", "leaf").agg(F.count("*").alias("n")).withColumn("home", F.min("leaf").over(Window.partitionBy("id")))
    for r in met.groupBy("leaf").agg(F.sum("n"), F.count_if(F.col("leaf") == F.col("home"))).collect():  # two numbers per leaf
        count[r[0]], named[r[0]] = r[1], r[2]
    blocks = np.maximum(1, -(-count // block_rows))

    def visited(q: np.ndarray) -> list[int]:
        seen, out = 0, []
        for n, at in enumerate(tree.visit(q)):
            if n >= visits and seen > k:
                break
            seen += int(named[at])
            if count[at]:
                out.append(at)
        return out

    def callers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = np.zeros(tree.leaves, np.int64)
        for b in batches:
            for q in _matrix(b.column(0), dim).astype(np.float64) if b.num_rows else ():
                asking[visited(q)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tree.leaves)), pa.array(asking)], names=["leaf", "n"])

    asking = np.zeros(tree.leaves, np.int64)
    for r in asked.select("v").mapInArrow(callers, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect():  # a number per leaf
        asking[r[0]] = r[1]
    query_blocks = np.maximum(1, -(-asking // block_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick, leaves, parts = [], [], []
            for i, q in enumerate(_matrix(b.column(1), dim).astype(np.float64)) if b.num_rows else ():
                for at in visited(q):
                    pick += [i] * int(blocks[at])
                    leaves += [at] * int(blocks[at])
                    parts += range(int(blocks[at]))
            chosen = pa.RecordBatch.from_arrays(b.columns, names=["query_id", "v"]).take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(leaves, pa.int64()), pa.array(parts, pa.int64())], names=["query_id", "v", "leaf", "part"])

    of_leaf = lambda numbers: F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), (F.col("leaf") + 1).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), of_leaf(blocks)))
    placed = placed.withColumn("ask", F.explode(F.sequence(F.lit(0), of_leaf(query_blocks) - 1)))
    routed = asked.mapInArrow(route, f"query_id long, v {kind}, leaf long, part long")
    routed = routed.withColumn("ask", F.pmod(F.xxhash64("query_id"), of_leaf(query_blocks)).cast("int"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        found = _nearest_rows(q, r, k, dim) if q.num_rows and r.num_rows else []
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    found = routed.groupBy("leaf", "part", "ask").cogroup(placed.groupBy("leaf", "part", "ask")).applyInArrow(search, "query_id long, id long, score double")
    best = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


def nearest_to_hundredths(embeddings: DataFrame) -> DataFrame:
    """The 10 nearest rows of each row whose vec_id is divisible by 100."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))
