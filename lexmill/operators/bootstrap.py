"""Cluster bootstrap over per-group sums, paired tests and Holm's correction.

Drawing groups with replacement only changes how often each group counts, so replicates are weighted sums of
per-group statistics. ``drawn_sums`` draws the weights where the groups are and moves nothing but those sums, a row
a replicate and task. ``group_weights`` gives weights as a table, groups times replicates: its draws are hashes (seed,
replicate, draw), the same in any engine and any layout; ``numpy_weights`` gives the sequence of a numpy generator
instead, for comparison on small inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import cut, dense_index


def hash_draw(seed: int, rep: Column, draw: Column, n: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), draw.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % n


def group_weights(groups: DataFrame, group: str, iterations: int, seed: int, bucket: Column | None = None) -> DataFrame:
    """Rows (rep, group, weight > 0): how often each group was drawn in each replicate. Groups are numbered inside buckets, by default of their hash."""
    idx = dense_index(groups.select(group).distinct(), F.pmod(F.xxhash64(group), F.lit(4096)) if bucket is None else bucket, [group])
    n = groups.select(group).distinct().agg(F.count("*").alias("n"))
    drawn = idx.select("idx", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("rep"))
    n = n.first()[0]
    counts = drawn.groupBy("rep", hash_draw(seed, F.col("rep"), F.col("idx"), F.lit(n)).alias("pick")).agg(F.count("*").cast("double").alias("weight"))
    return counts.join(idx, counts["pick"] == idx["idx"]).select("rep", group, "weight")


def numpy_weights(spark: SparkSession, groups: list, group: str, iterations: int, seed: int) -> DataFrame:
    """The same from numpy's generator; groups in the order of their first row. For small inputs: made on the driver."""
    rng, rows = np.random.default_rng(seed), []
    for rep in range(iterations):
        counts = np.bincount(rng.choice(len(groups), size=len(groups), replace=True), minlength=len(groups))
        rows += [(rep, groups[i], float(c)) for i, c in enumerate(counts) if c]
    kind = "string" if groups and isinstance(groups[0], str) else "long"
    return spark.createDataFrame(rows, f"rep int, {group} {kind}, weight double")


def part_draws(counts: np.ndarray, part: int, iterations: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws, as many as there are groups, fall on the groups of one part.

    Draws go down a binary tree of ranges of parts. At each node a binomial draw, seeded by the node, deals them to its
    halves, so every task finds the same numbers for its own part without asking the others."""
    low, high, draws = 0, len(counts), np.full(iterations, int(counts.sum()), np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left, whole = int(counts[low:mid].sum()), int(counts[low:high].sum())
        taken = np.random.default_rng((seed, low, high)).binomial(draws, left / whole) if whole else draws * 0
        low, high, draws = (low, mid, taken) if part < mid else (mid, high, draws - taken)
    return draws


def drawn_sums(stats: DataFrame, columns: list[str], iterations: int, seed: int, cells: int = 1 << 22, kept: bool = False) -> DataFrame:
    """Rows (rep, *columns): each replicate's weighted sums of columns over stats, which has one row a group.

    The groups are checkpointed once and stay in their parts; kept says that stats is a checkpoint already. A task takes its part's draws from the tree
    (``part_draws``), deals them on to stretches of at most ``cells`` / iterations groups by binomial draws and to the
    groups of a stretch one by one, and multiplies the weights with the stretch's columns; its iterations x columns sums
    are all that is shuffled. The law is that of drawing as many groups as there are, with replacement. Null is zero."""
    held = stats.select(F.spark_partition_id().alias("part"), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    held = held if kept else cut(held)
    met = dict(held.groupBy("part").count().collect())  # a number a part
    counts = np.array([met.get(p, 0) for p in range(max(met, default=-1) + 1)], np.int64)
    names, most = ["rep", *[f"c{i}" for i in range(len(columns))]], max(1, cells // iterations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, left, draws, rng = np.zeros((iterations, len(columns))), 0, np.zeros(iterations, np.int64), np.random.default_rng(seed)
        part = None
        for b in batches:
            of = b.column(0).to_numpy()
            values = np.stack([c.to_numpy() for c in b.columns[1:]], 1)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for low, high in zip(edges, edges[1:]):
                if low < high and of[low] != part:
                    part = int(of[low])
                    left, draws, rng = int(counts[part]), part_draws(counts, part, iterations, seed), np.random.default_rng((seed, part, len(counts), 1))
                for at in range(low, high, most):
                    x = values[at : min(at + most, high)]
                    own = rng.binomial(draws, len(x) / left)
                    picks = rng.integers(0, len(x), int(own.sum())) + np.repeat(np.arange(iterations) * len(x), own)
                    sums += np.bincount(picks, minlength=iterations * len(x)).reshape(iterations, len(x)) @ x
                    draws, left = draws - own, left - len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations, dtype=np.int32)), *[pa.array(c) for c in sums.T]], names=names)

    partial = held.mapInArrow(run, ", ".join(f"{n} {'double' if i else 'int'}" for i, n in enumerate(names)))
    return partial.groupBy("rep").agg(*[F.sum(f"c{i}").alias(c) for i, c in enumerate(columns)])


def drawn_means(stats: DataFrame, metrics: dict[str, tuple[str, str]], iterations: int, seed: int) -> DataFrame:
    """Rows (rep, *metrics) as ``replicate_means``, with the weights drawn where the groups are."""
    columns = list(dict.fromkeys(c for pair in metrics.values() for c in pair))
    sums = drawn_sums(stats, columns, iterations, seed)
    return sums.select("rep", *[F.try_divide(n, d).alias(k) for k, (n, d) in metrics.items()])


def drawn_paired_test(candidate: DataFrame, reference: DataFrame, group: str, metrics: dict[str, tuple[str, str]], iterations: int, seed: int) -> DataFrame:
    """``paired_test`` with the weights drawn where the groups are: both sides' sums of a group get the same weight."""
    columns = list(dict.fromkeys(c for pair in metrics.values() for c in pair))
    both = candidate.join(reference.select(group, *[F.col(c).alias(f"r_{c}") for c in reference.columns if c != group]), group)
    gap = lambda one: [(F.try_divide(one(n), one(d)) - F.try_divide(one(f"r_{n}"), one(f"r_{d}"))).alias(k) for k, (n, d) in metrics.items()]
    sums = drawn_sums(both, [*columns, *[f"r_{c}" for c in columns]], iterations, seed)
    return _tested(both.agg(*gap(F.sum)), sums.select(*gap(F.col)), list(metrics))


def replicate_means(stats: DataFrame, weights: DataFrame, group: str, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows (rep, *metrics): each metric is a ratio of two per-group sums."""
    j = weights.join(stats, group)
    ratio = lambda n, d: F.try_divide(F.sum(F.col("weight") * F.col(n)), F.sum(F.col("weight") * F.col(d)))
    return j.groupBy("rep").agg(*[ratio(n, d).alias(k) for k, (n, d) in metrics.items()])


def interval(values: Column) -> list[Column]:
    """Bounds of the central 95 per cent of finite values."""
    finite = F.when(values.isNotNull() & ~F.isnan(values) & (F.abs(values) < float("inf")), values)
    return [F.coalesce(F.percentile(finite, q), F.lit(float("nan"))) for q in (0.025, 0.975)]


def intervals(stats: DataFrame, replicates: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows (metric, estimate, lower, upper)."""
    whole = stats.agg(*[F.try_divide(F.sum(n), F.sum(d)).alias(k) for k, (n, d) in metrics.items()])
    long = lambda df, v: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias(v)) for k in metrics])).alias("x")).select("x.*")
    lower, upper = interval(F.col("v"))
    spread = long(replicates, "v").groupBy("metric").agg(lower.alias("lower"), upper.alias("upper"))
    return long(whole, "estimate").join(spread, "metric").select("metric", "estimate", "lower", "upper")


def paired_test(candidate: DataFrame, reference: DataFrame, weights: DataFrame, group: str, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows (metric, difference, lower, upper, p_value): both sides under the same draws; two-sided tail with one added."""
    both = candidate.join(reference.select(group, *[F.col(c).alias(f"r_{c}") for c in reference.columns if c != group]), group)
    ratio = lambda n, d, w: F.try_divide(F.sum(w * F.col(n)), F.sum(w * F.col(d)))
    gap = lambda w: [(ratio(n, d, w) - ratio(f"r_{n}", f"r_{d}", w)).alias(k) for k, (n, d) in metrics.items()]
    reps = weights.join(both, group).groupBy("rep").agg(*gap(F.col("weight")))
    return _tested(both.agg(*gap(F.lit(1.0))), reps, list(metrics))


def _tested(whole: DataFrame, reps: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows (metric, difference, lower, upper, p_value) from the differences of all groups and of each replicate."""
    long = lambda df, v: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias(v)) for k in metrics])).alias("x")).select("x.*")
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v)
    tail = lambda c: (F.count_if(finite & c) + 1.0) / (F.count_if(finite) + 1.0)
    p = F.when(F.count_if(finite) > 0, F.least(F.lit(1.0), 2 * F.least(tail(v <= 0), tail(v >= 0)))).otherwise(float("nan"))
    lower, upper = interval(v)
    spread = long(reps, "v").groupBy("metric").agg(lower.alias("lower"), upper.alias("upper"), p.alias("p_value"))
    return long(whole, "difference").join(spread, "metric").select("metric", "difference", "lower", "upper", "p_value")


def holm(tests: DataFrame, name: str = "metric", p: str = "p_value") -> DataFrame:
    """The tests with ``adjusted``: step-down correction over the p-values that are numbers; NaN stays NaN."""
    w = Window.orderBy(p, name)  # one row per endpoint
    real = tests.where(F.col(p).isNotNull() & ~F.isnan(p))
    ranked = real.withColumns({"__r": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy())})
    raised = ranked.withColumn("adjusted", F.max(F.least(F.lit(1.0), (F.col("__n") - F.col("__r")) * F.col(p))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = tests.where(F.col(p).isNull() | F.isnan(p)).withColumn("adjusted", F.lit(float("nan")))
    return raised.drop("__r", "__n").unionByName(rest)


def paired_rows(candidate: DataFrame, reference: DataFrame, key: list[str], group: str, truth: list[str]) -> DataFrame:
    """One row: rows, unique_samples, repeated_samples, repeated_rows, conflicting_truth_samples and mismatches.

    Both sides must hold, per sample, the same multiset of (group, truth)."""
    cols = [*key, group, *truth]
    side = lambda df, n: df.groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]).agg(F.count("*").alias(n))
    a, b = side(candidate, "left_n"), side(reference, "right_n")
    on = None
    for i in range(len(cols)):
        e = a[f"k{i}"].eqNullSafe(b[f"k{i}"])
        on = e if on is None else on & e
    j = a.join(b, on, "full").select(*[F.coalesce(a[f"k{i}"], b[f"k{i}"]).alias(f"k{i}") for i in range(len(key))], "left_n", "right_n")
    wrong = ~F.coalesce(F.col("left_n") == F.col("right_n"), F.lit(False))
    per = j.groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.sum("left_n").alias("n"), F.count("left_n").alias("kinds"), F.count_if(wrong).alias("wrong"))
    many = F.col("n") > 1
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("n").alias("unique_samples"), F.count_if(many).alias("repeated_samples"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("repeated_rows"), F.count_if(many & (F.col("kinds") > 1)).alias("conflicting_truth_samples"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("mismatches"),
    )


def strict_pairs(candidate: DataFrame, reference: DataFrame, key: list[str], group: str, truth: list[str]) -> DataFrame:
    """Rows (*key, problem) of samples that don't pair one to one: no_key, repeated, missing, other_group or other_truth, the first that holds."""
    facts = F.struct(*truth) if truth else F.lit(0)
    side = lambda df, s: df.groupBy(*[F.col(c).alias(f"{s}{i}") for i, c in enumerate(key)]).agg(F.count("*").alias(f"{s}n"), F.min(group).alias(f"{s}g"), F.min(facts).alias(f"{s}t"))
    a, b = side(candidate, "a"), side(reference, "b")
    on = [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(key))]
    ids = [F.coalesce(f"a{i}", f"b{i}").alias(c) for i, c in enumerate(key)]
    empty = F.greatest(*[F.coalesce(f"a{i}", f"b{i}").isNull().cast("int") for i in range(len(key))], F.lit(0)) == 1
    problem = (
        F.when(empty, "no_key").when((F.col("an") > 1) | (F.col("bn") > 1), "repeated").when(F.col("an").isNull() | F.col("bn").isNull(), "missing")
        .when(~F.col("ag").eqNullSafe(F.col("bg")), "other_group").when(~F.col("at").eqNullSafe(F.col("bt")), "other_truth")
    )
    return a.join(b, on, "full").select(*ids, problem.alias("problem")).where("problem IS NOT NULL")


def require_pairs(candidate: DataFrame, reference: DataFrame, key: list[str], group: str, truth: list[str]) -> None:
    """An error that names one sample that doesn't pair one to one."""
    if bad := strict_pairs(candidate, reference, key, group, truth).first():
        raise ValueError(f"{bad['problem']}: {[bad[k] for k in key]}")
