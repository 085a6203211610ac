"""Exact keys, MinHash signatures and near-duplicates across splits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import content_key, normalize_text
from .components import cut, spread_join

PRIME = (1 << 31) - 1
BASE = 1000003


def coefficients(n: int = 64, seed: int = 20261024) -> tuple[list[int], list[int]]:
    """The permutations' factors and shifts. The seed and the order of draws are fixed values."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, PRIME, n, dtype=np.uint64)
    b = rng.integers(0, PRIME, n, dtype=np.uint64)
    return a.tolist(), b.tolist()


def signatures(df: DataFrame, text: str = "text", key: str = "key", n: int = 64, shingle: int = 5, seed: int = 20261024) -> DataFrame:
    """Rows (key, sig): MinHash of each distinct normalised text's character shingles.

    Signatures are made where texts are read, a vectorised kernel over Arrow batches; what is exchanged to
    make keys distinct is a signature a row, not its text or its shingles. ``native_signatures`` gives the
    same from built-in expressions."""
    a, b = (np.array(x, np.uint64)[:, None] for x in coefficients(n, seed))
    p, bits, most = np.uint64(PRIME), np.uint64(31), 512
    product, folded = np.empty((n, most), np.uint64), np.empty((n, most), np.uint64)
    short, over = np.empty((n, most), np.uint32), np.empty((n, most), np.uint32)

    def reduced(x: np.ndarray) -> np.ndarray:
        """Modulo 2^31 - 1: the upper bits are added to the lower ones."""
        x = (x & p) + (x >> bits)
        x = (x & p) + (x >> bits)
        return np.where(x >= p, x - p, x)

    def least(h: np.ndarray) -> np.ndarray:
        """The least of each permutation's values: one fold leaves under 2 * (2^31 - 1), which 32 bits hold; the lesser of that and that
        less 2^31 - 1 (which wraps where it is negative) is the remainder. Blocks of ``most`` stay in a core's cache."""
        low = np.full(n, PRIME, np.uint32)
        for at in range(0, len(h), most):
            part = h[at : at + most]
            x, y, u, v = (z[:, : len(part)] for z in (product, folded, short, over))
            np.multiply(part, a, out=x)
            np.add(x, b, out=x)
            np.right_shift(x, bits, out=y)
            np.bitwise_and(x, p, out=x)
            np.add(x, y, out=u, casting="unsafe")
            np.subtract(u, np.uint32(PRIME), out=v)
            np.minimum(u, v, out=u)
            np.minimum(low, u.min(1), out=low)
        return low.astype(np.int64)

    def one(t: str) -> np.ndarray:
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
        if not len(codes):
            codes = np.zeros(1, np.uint64)
        width = min(shingle, len(codes))
        h = np.zeros(len(codes) - width + 1, np.uint64)
        for k in range(width):  # a code takes 21 bits and a power 31
            h += codes[k : k + len(h)] * np.uint64(pow(BASE, width - 1 - k, PRIME))
            if k % 1024 == 1023:
                h = reduced(h)
        h = np.sort(reduced(h))
        return least(h[np.concatenate([[True], h[1:] != h[:-1]])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sigs = np.concatenate([one(t or "") for t in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(np.arange(0, len(sigs) + 1, n, dtype=np.int32), sigs)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["k", "sig"])

    norm = normalize_text(text)
    made = df.select(F.sha2(norm, 256).alias("k"), norm.alias("t")).mapInArrow(run, "k string, sig array<long>")
    return made.groupBy(F.col("k").alias(key)).agg(F.any_value("sig").alias("sig"))


def native_signatures(df: DataFrame, text: str = "text", key: str = "key", n: int = 64, shingle: int = 5, seed: int = 20261024) -> DataFrame:
    """The same signatures from built-in expressions: a shingle's polynomial is a sum of codes times powers modulo a Mersenne prime,
    so that all products and their sum fit a long and one remainder is taken. Places are exploded, not hashes: what is worked
    out a shingle is compiled, not a lambda's. The minima are combined map-side before one shuffle on the key."""
    a, b = coefficients(n, seed)
    norm = df.select(normalize_text(text).alias("t")).distinct().withColumn(key, F.sha2("t", 256))
    codes = norm.select(key, F.transform(F.split("t", ""), lambda c: F.ascii(c)).alias("c"))
    # zeros in front of a short text don't change its polynomial; an empty one's is zero
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(shingle) - F.size("c"), F.lit(0)))
    rows = codes.select(key, F.concat(zeros, "c").alias("c"))
    places = rows.select(key, "c", F.explode(F.sequence(F.lit(0), F.size("c") - shingle)).alias("i"))
    terms = [F.get("c", F.col("i") + k).cast("long") * pow(BASE, shingle - 1 - k, PRIME) for k in range(shingle)]
    flat = places.select(key, (reduce(add, terms) % PRIME).alias("h"))
    minima = flat.groupBy(key).agg(*[F.min((F.col("h") * x + y) % PRIME).alias(f"m{i}") for i, (x, y) in enumerate(zip(a, b))])
    return minima.select(key, F.array(*[f"m{i}" for i in range(n)]).alias("sig"))


def agreement(a: str, b: str):
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def blocks_of(sig: str, bands: int):
    """A hash of each band's places, the band's number among them."""
    rows = F.size(sig) / bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(sig, (i * rows).cast("int") + 1, rows.cast("int"))))


def cross_near_duplicates(sigs: DataFrame, key: str = "key", split: str = "split", bands: int = 8, threshold: float = 0.9) -> DataFrame:
    """Rows (a, b), a < b, of keys in different splits whose signatures agree enough.

    With eight bands of eight rows an agreement of 0.9 can't miss every band, so banding loses nothing. A pair is
    verified and listed at the first band in which it meets, so no list is made distinct. The result has a row a pair:
    ``cross_links`` gives the same components with about a link a key."""
    keyed = sigs.select(key, split, "sig", blocks_of("sig", bands).alias("blocks")).select("*", F.posexplode("blocks").alias("band", "block"))
    side = lambda n: keyed.select(F.col(key).alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("sig", "blocks")], F.col(split).alias(f"split_{n}"), "band", "block")
    first = F.array_position(F.zip_with("blocks_a", "blocks_b", lambda x, y: x == y), True) - 1
    pairs = side("a").join(side("b"), ["band", "block"]).where("split_a < split_b").where(first == F.col("band")).where(agreement("sig_a", "sig_b") >= threshold)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def cross_links(sigs: DataFrame, key: str = "key", split: str = "split", bands: int = 8, threshold: float = 0.9, few: int = 32, block: int = 4096) -> DataFrame:
    """Links (a, b) that join the same keys as the pairs of ``cross_near_duplicates``, without listing a crowded bucket's pairs.

    Keys of one signature are a class, which its least key stands for. Classes meet in buckets, a band's hash each. In one
    of ``few`` classes at most, pairs are joined. In a larger one every class is first compared with two anchors: the
    class of most keys, and the least of those linked to it. What is linked to either is one component already, its
    core; only the classes outside it are compared with all others, in groups of about ``block`` by ``block`` whose
    tasks return a link a join of components. The keys of a class follow where their class has links or several splits.
    Null signatures and splits have no links."""
    sigs = cut(sigs.select(F.col(key).alias("key"), F.col(split).cast("string").alias("split"), "sig").where("key IS NOT NULL AND split IS NOT NULL AND sig IS NOT NULL"))
    classes = cut(sigs.groupBy("sig").agg(F.min("key").alias("rep"), F.count("*").alias("keys"), F.sort_array(F.collect_set("split")).alias("splits")))
    keyed = classes.withColumn("bucket", F.explode(blocks_of("sig", bands)))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("splits")))).alias("apart"))  # sets of splits are few
    met = cut(spread_join(keyed, sizes.where("n > 1 AND apart > 1").drop("apart"), "bucket").where("n IS NOT NULL"))
    linked = lambda x, y: (F.size(F.array_union(f"splits{x}", f"splits{y}")) > 1) & (agreement(f"sig{x}", f"sig{y}") >= threshold)
    small = met.where(F.col("n") <= few).select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("rep", "sig", "splits")])
    other = met.where(F.col("n") <= few).select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("rep", "sig", "splits")])
    links = small.join(other, "bucket").where("rep_a < rep_b").where(linked("_a", "_b")).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    large = met.where(F.col("n") > few)
    if not large.isEmpty():
        links = links.unionByName(_crowded(large, linked, threshold, block))
    links = cut(links.distinct())
    touched = links.select(F.col("a").alias("rep")).union(links.select("b")).union(classes.where(F.size("splits") > 1).select("rep")).distinct()
    kept = classes.select("sig", "rep").join(touched, "rep", "left_semi")
    own = spread_join(sigs.select("key", "sig"), kept, "sig").where("rep < key").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(own)


def _crowded(large: DataFrame, linked, threshold: float, block: int) -> DataFrame:
    """Links of the buckets whose classes are too many to be paired by a join; see ``cross_links``."""
    fields = ("rep", "sig", "splits")
    first = large.groupBy("bucket").agg(F.min_by(F.struct(*[F.col(c).alias(f"{c}_x") for c in fields]), F.struct(-F.col("keys"), "rep")).alias("x")).select("bucket", "x.*")
    near = cut(spread_join(large, first, "bucket").withColumn("by_x", linked("", "_x")).drop("sig_x", "splits_x"))
    second = near.where("by_x").groupBy("bucket").agg(F.min_by(F.struct(*[F.col(c).alias(f"{c}_y") for c in fields]), "rep").alias("y")).select("bucket", "y.*")
    seen = spread_join(near, second, "bucket").withColumn("by_y", F.coalesce(linked("", "_y"), F.lit(False)))
    seen = cut(seen.select("bucket", "n", *fields, "rep_x", "rep_y", "by_x", "by_y", (F.col("by_x") | F.col("by_y") | (F.col("rep") == F.col("rep_x"))).alias("core")))
    anchored = seen.where("by_x").select(F.col("rep_x").alias("a"), F.col("rep").alias("b")).unionByName(seen.where("by_y").select(F.col("rep_y").alias("a"), F.col("rep").alias("b")))
    outside = seen.where("NOT core").groupBy("bucket").agg(F.count("*").alias("out"))
    cells = spread_join(seen, outside, "bucket").where("out IS NOT NULL").select("bucket", *fields, "core", F.ceil(F.col("out") / block).alias("p"), F.ceil(F.col("n") / block).alias("q"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    row = cells.where("NOT core").withColumn("i", place("p")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).withColumn("all", F.lit(False))
    column = cells.withColumn("j", place("q")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("all", F.lit(True))

    def compared(t: pa.Table) -> pa.Table:
        reps, core = t["rep"].to_pylist(), t["core"].to_numpy()
        sig = np.stack(t["sig"].to_numpy(zero_copy_only=False)).astype(np.int64)
        sets: dict = {}
        kind = np.array([sets.setdefault(tuple(s), len(sets)) for s in t["splits"].to_pylist()])
        alone = np.array([len(s) == 1 for s in sets])[kind]
        whole, need = t["all"].to_numpy(), threshold * sig.shape[1]
        among = np.flatnonzero(whole)
        place: dict = {}
        label = np.array([place.setdefault(r, n) for n, r in enumerate(reps)])  # a class has one label on both sides
        if core.any():
            label[core] = label[core].min()
        a, b = [], []
        for n in np.flatnonzero(~whole):
            at = among[((kind[among] != kind[n]) | ~alone[n]) & (label[among] != label[n])]
            at = at[(sig[at] == sig[n]).sum(1) >= need]
            joined, where = np.unique(label[at], return_index=True)
            for k in where:
                a.append(reps[n])
                b.append(reps[at[k]])
            if len(joined):
                label[np.isin(label, joined)] = label[n]
        return pa.table({"a": pa.array(a, t["rep"].type), "b": pa.array(b, t["rep"].type)})

    named = dict(large.dtypes)["rep"]
    groups = row.unionByName(column).groupBy("bucket", "i", "j")
    return anchored.unionByName(groups.applyInArrow(compared, f"a {named}, b {named}"))


def content_keys(df: DataFrame, text: str = "text", out: str = "key") -> DataFrame:
    return df.withColumn(out, content_key(text))
