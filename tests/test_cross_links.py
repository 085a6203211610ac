"""Links of near-duplicates across splits: the same components as all pairs, without listing the pairs of a crowded bucket."""

import numpy as np
import pytest

from lexmill.operators import dedup
from lexmill.operators.components import connected

SCHEMA = "key string, split string, sig array<long>"


def roots_of(pairs, keys):
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    return {k: root(k) for k in keys if root(k) != k}


def all_pairs(rows, threshold=0.9):
    m = np.array([r[2] for r in rows])
    return [
        (rows[i][0], rows[j][0]) for i in range(len(rows)) for j in np.flatnonzero((m == m[i]).mean(1) >= threshold)
        if j > i and rows[i][1] != rows[j][1]
    ]


def drawn(seed, n, groups, most, splits=("train", "valid", "test"), shares=(0.8, 0.1, 0.1)):
    """Signatures of a few originals with up to ``most`` places changed, each in a split."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 31, (groups, 64))
    out = []
    for k in range(n):
        sig = base[rng.integers(groups)].copy()
        at = rng.choice(64, rng.integers(0, most + 1), replace=False)
        sig[at] = rng.integers(0, 1 << 31, len(at))
        out.append((f"k{k:05d}", str(rng.choice(splits, p=shares)), [int(x) for x in sig]))
    return out


@pytest.mark.parametrize("seed,n,groups,most,few,block", [(1, 300, 60, 6, 32, 4096), (2, 400, 2, 5, 8, 64), (3, 400, 2, 9, 4, 50), (4, 300, 1, 12, 2, 40), (5, 200, 3, 0, 2, 40)])
def test_components_are_those_of_all_pairs(spark, seed, n, groups, most, few, block):
    rows = drawn(seed, n, groups, most)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = roots_of(all_pairs(rows), [r[0] for r in rows])
    links = dedup.cross_links(df, few=few, block=block).persist()
    assert {r.node: r.root for r in connected(links).collect()} == want
    pairs = {(r.a, r.b) for r in dedup.cross_near_duplicates(df).collect()}
    listed = dedup.cross_near_duplicates(df).count()
    assert pairs == {tuple(sorted(p)) for p in all_pairs(rows)} and listed == len(pairs)


def test_copies_of_one_split_alone_have_no_links(spark):
    rows = [(k, "train", s) for k, _, s in drawn(6, 60, 1, 2)]
    assert dedup.cross_links(spark.createDataFrame(rows, SCHEMA), few=2).count() == 0


def test_a_crowded_text_has_about_a_link_a_key(spark):
    rows = drawn(7, 20_000, 1, 1, ("train", "test"), (0.7, 0.3))
    links = dedup.cross_links(spark.createDataFrame(rows, SCHEMA).repartition(4)).persist()
    assert links.count() < 3 * len(rows)  # all pairs would be 80 million
    assert connected(links).select("root").distinct().count() == 1
    assert connected(links).count() == len(rows) - 1


def test_nulls_repeated_rows_and_empty_tables(spark):
    sig = list(range(64))
    rows = [("a", "train", sig), ("a", "train", sig), ("b", "test", sig), ("c", None, sig), ("d", "test", None), (None, "test", sig)]
    assert {(r.a, r.b) for r in dedup.cross_links(spark.createDataFrame(rows, SCHEMA)).collect()} == {("a", "b")}
    assert dedup.cross_links(spark.createDataFrame([], SCHEMA)).count() == 0
