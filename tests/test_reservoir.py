"""A reservoir a task, merged by hypergeometric shares: every row as likely as any other."""

import numpy as np
import pyarrow as pa
import pytest

from lexmill.operators import metrics


def chi_squared(counts):
    mean = np.mean(counts)
    return ((np.array(counts) - mean) ** 2 / mean).sum()


def test_places_of_one_task_are_uniform():
    hits = np.zeros(60)
    for seed in range(3000):
        kept = metrics.Reservoir(7, np.random.default_rng(seed))
        for at, size in ((0, 3), (3, 10), (13, 1), (14, 46)):
            kept.add(pa.record_batch({"v": pa.array(range(at, at + size))}))
        got = kept.shuffled()["v"].to_numpy()
        assert len(set(got)) == 7 and kept.seen == 60
        hits[got] += 1
    assert chi_squared(hits) * (60 / 53) < 105  # 59 degrees of freedom; 105 is beyond the 99.98th percentile


def test_shares_have_the_means_of_the_law():
    seen, n = [0, 5, 1000, 3_000_000_000, 995], 40
    assert sum(metrics.shares(seen, n, 1)) == n and metrics.shares([3, 2], 99, 1) == [3, 2] and metrics.shares([], 5, 1) == []
    small = np.array([metrics.shares([10, 30, 60], 20, seed) for seed in range(3000)])
    assert small.mean(0) == pytest.approx([2, 6, 12], rel=0.05)
    assert small[:, 0].var() == pytest.approx(20 * 0.1 * 0.9 * 80 / 99, rel=0.1)  # without replacement


def test_sample_over_uneven_tasks(spark):
    rows = spark.range(900, numPartitions=1).union(spark.range(900, 930, numPartitions=3)).union(spark.range(930, 1000, numPartitions=2)).persist()
    hits = np.zeros(1000)
    for seed in range(30):
        got = [r.id for r in metrics.reservoir_sample(rows, 200, seed).collect()]
        assert len(got) == len(set(got)) == 200
        hits[got] += 1
    parts = [hits[a:a + 50].sum() for a in range(0, 1000, 50)]
    assert chi_squared(parts) * (1000 / 800) < 46  # 19 degrees of freedom; 46 is beyond the 99.9th percentile
    assert sorted(r.id for r in metrics.reservoir_sample(rows, 200, 3).collect()) == sorted(r.id for r in metrics.reservoir_sample(rows, 200, 3).collect())


def test_small_tables_nulls_repeats_and_names(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x" * 100_000), (2, "")], "task long, seen string")
    got = metrics.reservoir_sample(df, 10)
    assert got.columns == ["task", "seen"] and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert metrics.reservoir_sample(df, 3).count() == 3
    assert metrics.reservoir_sample(df, 0).count() == 0 and metrics.reservoir_sample(df.limit(0), 5).count() == 0
    assert "Exchange rangepartitioning" not in metrics.reservoir_sample(df, 3)._jdf.queryExecution().toString()
