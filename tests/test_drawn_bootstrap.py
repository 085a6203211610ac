"""Bootstrap weights drawn where the groups are: the law of drawing with replacement, whatever the layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import bootstrap

N, REPS = 12, 4000


def weights(spark, parts, cells=1 << 22):
    """Replicates x groups: each group's column is one for itself and zero elsewhere."""
    groups = spark.range(0, N, 1, parts).select(*[(F.col("id") == i).cast("double").alias(f"g{i}") for i in range(N)])
    rows = bootstrap.drawn_sums(groups, [f"g{i}" for i in range(N)], REPS, 11, cells).orderBy("rep").collect()
    return np.array([r[1:] for r in rows])


@pytest.mark.parametrize("parts,cells", [(1, 1 << 22), (5, 1 << 22), (1, 3 * REPS), (3, REPS)])
def test_weights_follow_the_multinomial_law(spark, parts, cells):
    w = weights(spark, parts, cells)
    assert w.shape == (REPS, N) and (w.sum(1) == N).all() and (w >= 0).all()
    assert np.abs(w.mean(0) - 1).max() < 5 * np.sqrt((1 - 1 / N) / REPS)
    cov = np.cov(w.T)
    assert np.abs(np.diag(cov) - (1 - 1 / N)).max() < 0.12 and np.abs(cov[~np.eye(N, dtype=bool)] + 1 / N).max() < 0.09
    expected = np.random.default_rng(3).multinomial(N, [1 / N] * N, REPS)
    for k in range(4):  # how often a group is drawn k times
        assert abs((w == k).mean() - (expected == k).mean()) < 0.01


def test_parts_agree_on_the_tree():
    counts = np.array([3, 0, 10, 1, 700, 2, 50])
    dealt = np.stack([bootstrap.part_draws(counts, p, 50, 4) for p in range(len(counts))])
    assert (dealt.sum(0) == counts.sum()).all() and (dealt[1] == 0).all()


def test_intervals_agree_with_the_table_of_weights(spark):
    stats = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("s"), F.lit(1.0).alias("n"))
    metrics = {"m": ("s", "n")}
    drawn = bootstrap.intervals(stats, bootstrap.drawn_means(stats, metrics, 400, 5), metrics).first()
    hashed = bootstrap.intervals(stats, bootstrap.replicate_means(stats, bootstrap.group_weights(stats, "id", 400, 5), "id", metrics), metrics).first()
    assert drawn.estimate == hashed.estimate
    assert drawn.lower == pytest.approx(hashed.lower, abs=0.05) and drawn.upper == pytest.approx(hashed.upper, abs=0.05)
    better = stats.withColumn("s", F.col("s") + 1)
    test = bootstrap.drawn_paired_test(better, stats, "id", metrics, 100, 5).first()
    assert (test.difference, test.lower, test.upper) == pytest.approx((1, 1, 1)) and test.p_value == pytest.approx(2 / 101)


def test_shuffle_does_not_grow_with_the_groups(spark):
    def moved(n):
        plan = bootstrap.drawn_sums(spark.range(0, n, 1, 4).select(F.lit(1.0).alias("x")), ["x"], 20, 1)
        return plan.select(F.count("*")).first()[0], plan.agg(F.sum("x")).first()[0]

    assert moved(400) == (20, 400 * 20) and moved(40_000) == (20, 40_000 * 20)
    assert bootstrap.drawn_sums(spark.range(0).select(F.lit(1.0).alias("x")), ["x"], 3, 1).agg(F.sum("x")).first()[0] in (None, 0.0)


def test_cases_are_evaluated_without_a_table_of_weights(spark, monkeypatch):
    import json

    from lexmill.plans import evaluate

    kind = F.lit("fixed_term")
    i = F.col("id")
    rows = spark.range(0, 900, 1, 3).select((i % 300).alias("group_id"), (i % 7 != 0).alias("correct"), (i % 5 != 0).alias("article_correct"), kind.alias("penalty_type"), kind.alias("predicted_penalty_type"), (i % 40).cast("double").alias("true_months"), (i % 41).cast("double").alias("predicted_months"))
    names = ["defendant_full_accuracy", "case_charge_accuracy", "case_count"]
    table = evaluate.replicates(rows, "cmdl", bootstrap.group_weights(rows, "group_id", 300, 5))
    bounds = {n: table.agg(*bootstrap.interval(F.col(n).cast("double"))).first() for n in names}
    monkeypatch.setattr(bootstrap, "group_weights", None)
    got = {r.metric: r for r in evaluate.evaluate(rows, "cmdl", 300, 5, names=names).collect()}
    whole = evaluate.metrics_of(rows, "cmdl").first()
    for n in names:
        assert got[n].estimate == whole[n] and (got[n].lower, got[n].upper) == pytest.approx(tuple(bounds[n]), abs=0.02)
    told = json.loads(evaluate.payload(rows, "cmdl", 20, names=names).first()[0])
    assert told["metrics"]["case_count"] == 300 and set(told["confidence_intervals"]) == set(names)
