"""Orders without a sort, and thresholds counted in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions.columns import thresholded
from lexmill.operators import batches, metrics


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000, 4097])
def test_places_are_a_bijection(spark, n):
    rows = spark.range(n).select("id", batches.permuted(F.col("id"), n, 7, 2).alias("place")).withColumn("back", batches.permuted(F.col("place"), n, 7, 2, back=True)).collect()
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_passes_differ_and_cursors_read_what_is_left(spark):
    n = 3000
    of = lambda seed, epoch: [r.place for r in batches.placed(spark.range(n), "id", n, seed, epoch).orderBy("id").collect()]
    a, b = of(1, 0), of(1, 1)
    assert a == of(1, 0) and sum(x == y for x, y in zip(a, b)) < 15
    # neighbours are no neighbours any more: the mean distance of a uniform order is n / 3
    assert sum(abs(x - y) for x, y in zip(a, a[1:])) / (n - 1) == pytest.approx(n / 3, rel=0.06)
    left = batches.placed(spark.range(n), "id", n, 1, 0, start=2990).collect()
    assert sorted(r.place for r in left) == list(range(2990, n))
    ahead = batches.next_rows(spark, n, 1, 0, 2990, 100).collect()
    assert {(r.place, r.idx) for r in ahead} == {(r.place, r.id) for r in left}
    plan = batches.placed(spark.range(n), "id", n, 1, 0)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_counts_equal_those_of_each_threshold(spark):
    rnd = random.Random(4)
    rows = [([round(rnd.random(), 2) for _ in range(k)], [rnd.randrange(2) for _ in range(k)]) for k in [0, 1, 2, 5, 5, 5, 9] * 20] + [([0.3, 0.3, 0.1], [1, 0, 1]), ([0.0, 0.0], [0, 1])]
    df = spark.createDataFrame(rows + [(None, [1]), ([0.5], None)], "p array<double>, t array<int>").repartition(5)
    grid = [0.05, 0.3, 0.5, 0.77, 0.99, 1.0, 2.0]
    got = {r.threshold: (r.tp, r.n) for r in metrics.threshold_counts(df, "p", "t", grid).collect()}
    for g in grid:
        hot = df.where("p IS NOT NULL AND t IS NOT NULL").select(thresholded("p", g).alias("h"), "t").collect()
        assert got[g] == (sum(a * b for r in hot for a, b in zip(r.h, r.t)), sum(sum(r.h) + sum(r.t) for r in hot))


def test_ten_thousand_thresholds(spark):
    df = spark.range(2000).select(F.array(*[F.rand(k) for k in range(4)]).alias("p"), F.array(*[(F.rand(k + 9) < 0.5).cast("int") for k in range(4)]).alias("t")).persist()
    best = metrics.tune_threshold(df, "p", "t", [k / 10_000 for k in range(1, 10_001)]).first()
    some = {r.threshold: 2 * r.tp / r.n for r in metrics.threshold_counts(df, "p", "t", [best.threshold, 0.5, 0.1]).collect()}
    assert best.micro_f1 == pytest.approx(some[best.threshold]) and best.micro_f1 >= max(some.values()) - 1e-12
    assert metrics.tune_threshold(df.limit(0), "p", "t").count() in (0, 1)


def test_walks_that_ended_are_not_gone_on_with(spark):
    plan = batches.placed(spark.range(70_000), "id", 70_000, 3, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Filter" not in plan  # were a stretch of all 64 walks a row, and all of it twice
    row = spark.range(1).select(batches.permuted(F.lit(5).cast("long"), 1000, 3, 1).alias("p"), batches.permuted(batches.permuted(F.lit(5).cast("long"), 1000, 3, 1), 1000, 3, 1, back=True).alias("q")).first()
    assert 0 <= row.p < 1000 and row.q == 5
