"""Components against a plain union-find, through several rounds, and with hubs."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import components


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root if find(x) != x}


def graph(kind):
    rnd = random.Random(5)
    if kind == "path":
        order = rnd.sample(range(3000), 3000)
        links = list(zip(order, order[1:]))
    elif kind == "sparse":
        links = [(rnd.randrange(2000), rnd.randrange(2000)) for _ in range(1100)]
    else:
        links = [(7, i) for i in range(1500)] + [(1400 + i, 5000 + i) for i in range(300)]
    rnd.shuffle(links)
    return links


@pytest.mark.parametrize("kind", ["path", "sparse", "hub"])
@pytest.mark.parametrize("alone", [0, 1 << 20])
def test_equal_to_union_find(spark, kind, alone):
    links = graph(kind)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r.node: r.root for r in components.connected(df, alone=alone, chunk=200).collect()}
    assert got == plain(links)


def test_text_nodes_nulls_and_empty(spark):
    links = [("b", "a"), ("é", "b"), ("x", None), (None, None), ("z", "z"), ("q", "p"), ("q", "p")]
    df = spark.createDataFrame(links, "a string, b string")
    assert {r.node: r.root for r in components.connected(df).collect()} == {"b": "a", "é": "a", "q": "p"}
    assert components.connected(df.limit(0)).count() == 0


def test_star_is_spread_over_tasks(spark):
    links = spark.range(0, 1_000_000, 1, 8).selectExpr("CAST(1000000 AS LONG) AS a", "id AS b")
    stars = components._contracted(links.selectExpr("a AS u", "b AS v"), 1 << 16).groupBy("node").agg(F.collect_set("root").alias("roots"))
    assert stars.agg(F.max(F.size("roots"))).first()[0] <= 24
    sizes = sorted(r[1] for r in stars.groupBy(F.pmod(F.hash("node"), F.lit(16))).count().collect())
    assert sizes[-1] < 1.1 * sizes[len(sizes) // 2]
    out = components.connected(links, chunk=1 << 16)
    assert out.agg(F.count("*"), F.max("root"), F.sum("node")).first() == (1_000_000, 0, 1_000_000 * 1_000_001 // 2)


def test_spread_join_finds_hot_keys(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, -1L, id % 2000) AS k")
    table = spark.range(-1, 1000).selectExpr("id AS k", "id * 2 AS x")
    got = {r.id: r.x for r in components.spread_join(rows, table, "k", 100).collect()}
    assert got == {i: (k * 2 if k < 1000 else None) for i in range(5000) for k in [-1 if i % 3 == 0 else i % 2000]}
