"""Batches by padded size, shards of batches, and restartable orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def token_batches(df: DataFrame, length: str, budget: int, most_rows: int, key: str, window: int = 4096, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Rows (key, length, shuffle_window, batch): inside windows of about ``window`` rows, the longest first, a batch
    closes when its longest length times its rows would pass the budget or its rows would pass most_rows.

    Rows come to windows by a seeded hash, so windows are of about equal size whatever the keys are."""
    n = max(1, df.count() // window)
    dealt = df.select(key, length).withColumn("shuffle_window", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key)), F.lit(n)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, key], ascending=[False, True], kind="stable")
        batch, rows, longest, out = 0, 0, 0, []
        for size in pdf[length]:
            if rows and (max(longest, size) * (rows + 1) > budget or rows >= most_rows):
                batch, rows, longest = batch + 1, 0, 0
            rows, longest = rows + 1, max(longest, size)
            out.append(batch)
        return pdf.assign(batch=out)

    kinds = dict(df.dtypes)
    return dealt.groupBy("shuffle_window").applyInPandas(pack, f"`{key}` {kinds[key]}, `{length}` {kinds[length]}, shuffle_window long, batch long")


def shard_of(batch: Column | str, shards: int) -> Column:
    return F.pmod(F.col(batch) if isinstance(batch, str) else batch, F.lit(shards))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Rows in an order that depends on seed, epoch and key only."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key)), key)


def permuted(index: Column, n: int, seed: int, epoch: int, back: bool = False, rounds: int = 6, walks: int = 64) -> Column:
    """Where a seeded permutation of 0 to n - 1 puts an index; with back, which index is at a place. No sort, no table.

    A Feistel network permutes the numbers of an even number of bits that n fits in, at most 4n of them; a result of n or more
    goes through it again until it falls below n (cycle walking), which keeps the map one to one. A walk misses with
    probability 3/4 at most, so that ``walks`` in a row are beyond any table's reach; that would be an error."""
    bits = max(1, -(-max(1, (max(n, 2) - 1).bit_length()) // 2))
    mask = F.lit((1 << bits) - 1)
    keys = [hash_key(seed, epoch, r) for r in range(rounds)]

    def once(x: Column) -> Column:
        # rounds go through a fold: its accumulator is computed once, where nested expressions would double
        pair = F.struct(F.shiftright(x, bits).alias("l"), x.bitwiseAND(mask).alias("r"))
        order = F.array(*[F.lit(k) for k in (keys[::-1] if back else keys)])

        def forward(p: Column, k: Column) -> Column:
            return F.struct(p["r"].alias("l"), p["l"].bitwiseXOR(F.xxhash64(k, p["r"]).bitwiseAND(mask)).alias("r"))

        def backward(p: Column, k: Column) -> Column:
            return F.struct(p["r"].bitwiseXOR(F.xxhash64(k, p["l"]).bitwiseAND(mask)).alias("l"), p["l"].alias("r"))

        return F.aggregate(order, pair, backward if back else forward, lambda p: F.shiftleft(p["l"], bits).bitwiseOR(p["r"]))

    def walked(x: Column, left: int, some: int) -> Column:
        # most walks end soon: the next stretch, twice as long, is gone through only where this one hasn't ended
        step, left = F.array(*[F.lit(1)] * min(some, left)), left - min(some, left)
        rest = (lambda y: walked(y, left, 2 * some)) if left else (lambda y: F.raise_error(F.lit("a walk didn't end")).cast("long"))
        return F.aggregate(step, x, lambda y, _: F.when(y < n, y).otherwise(once(y)), lambda y: F.when(y < n, y).otherwise(rest(y)))

    return walked(once(index.cast("long")), walks, 2)


def hash_key(seed: int, epoch: int, r: int) -> int:
    """A 63-bit key of a round."""
    digest = hashlib.blake2b(f"{seed}:{epoch}:{r}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") >> 1


def placed(df: DataFrame, index: str, n: int, seed: int, epoch: int, start: int = 0, name: str = "place") -> DataFrame:
    """Rows of dense numbers (0 to n - 1 in index) with their place in a pass, from place ``start`` on: a filter where rows are read."""
    out = df.withColumn(name, permuted(F.col(index), n, seed, epoch))
    return out.where(F.col(name) >= start) if start > 0 else out  # a filter computes the places once more


def next_rows(spark: SparkSession, n: int, seed: int, epoch: int, start: int, rows: int, index: str = "idx") -> DataFrame:
    """Rows (place, index) of the next places of a pass: only what is asked for is computed."""
    return spark.range(start, min(n, start + rows)).select(F.col("id").alias("place"), permuted(F.col("id"), n, seed, epoch, back=True).alias(index))


def numbered(batches: DataFrame) -> DataFrame:
    """Rows of token_batches with ``place``, the number of their batch over all windows; what one task orders is a row a window."""
    per = batches.groupBy("shuffle_window").agg((F.max("batch") + 1).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("shuffle_window").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return batches.join(per.select("shuffle_window", before.alias("__before")), "shuffle_window").withColumn("place", F.col("__before") + F.col("batch")).drop("__before")


def resumed(batches: DataFrame, state: dict[str, int], seed: int, epoch: int) -> DataFrame:
    """The numbered batches that a pass with this state (seed, epoch, start) still has to see; a state of another pass is an error."""
    if (state["seed"], state["epoch"]) != (seed, epoch):
        raise ValueError(f"the state is of seed {state['seed']}, epoch {state['epoch']}, not of {seed}, {epoch}")
    total = batches.agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]
    if not 0 <= state["start"] <= total:
        raise ValueError(f"batch {state['start']} of {total}")
    return batches.where(F.col("place") >= state["start"])


def similarity(parent: str, text: str) -> Column:
    """Ratio of matching stretches of two texts, as Python's sequence matcher without its popularity rule gives it."""
    import difflib

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])

    return run(F.col(parent), F.col(text))
