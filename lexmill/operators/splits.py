"""Split integrity: clusters of equal or near-equal content, and the split each one belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..presets import SPLIT_PRIORITY
from .components import connected
from .dedup import cross_links, signatures


def priority(split: Column, order: dict[str, int] = SPLIT_PRIORITY) -> Column:
    return F.element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), split)


def split_plan(df: DataFrame, dataset: str, text: str = "text", key: str = "key", split: str = "split", near: bool = True, order: dict[str, int] = SPLIT_PRIORITY) -> DataFrame:
    """Rows (key, cluster, assigned, group_id, n_splits): each content key's cluster goes to its most held-out split."""
    back = F.element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(v), F.lit(k))]), F.col("p"))
    per = df.select(key, priority(F.col(split), order).alias("p")).distinct()
    keys = per.groupBy(key).agg(F.max("p").alias("p"))
    if near:
        sigs = signatures(df, text, key).join(keys.withColumn(split, back), key)
        roots = connected(cross_links(sigs, key, split))
        clustered = per.join(roots, per[key] == roots["node"], "left").select(key, "p", F.coalesce("root", key).alias("cluster"))
    else:
        clustered = per.withColumn("cluster", F.col(key))
    whole = clustered.groupBy("cluster").agg(F.max("p").alias("p"), F.count_distinct("p").alias("n_splits"), F.min(key).alias("low"))
    named = whole.select("cluster", back.alias("assigned"), F.concat(F.lit(f"{dataset}-g"), F.substring("low", 1, 20)).alias("group_id"), "n_splits")
    return clustered.select(key, "cluster").distinct().join(named, "cluster")


def reassign(df: DataFrame, plan: DataFrame, key: str = "key", split: str = "split") -> DataFrame:
    """Rows whose cluster stays in their split, with its group."""
    return df.join(plan.select(key, "assigned", "group_id"), key).where(F.col(split) == F.col("assigned")).drop("assigned")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def drop_counts(df: DataFrame, plan: DataFrame, key: str = "key", split: str = "split", unit: str = "case_id") -> DataFrame:
    """Per split: units, kept and dropped by reassignment, and repeated ids among the kept."""
    j = df.join(plan.select(key, "assigned"), key).withColumn("stays", F.col(split) == F.col("assigned"))
    per = j.groupBy(split, unit).agg(F.count("*").alias("n"), F.count_if("stays").alias("k"))
    return per.groupBy(split).agg(
        F.sum("n").alias("units"), F.sum("k").alias("kept"), F.sum(F.col("n") - F.col("k")).alias("dropped"),
        F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("repeated_ids"),
    )


def vocabulary(df: DataFrame, labels: str, split: str = "split", train: str = "train") -> DataFrame:
    """Distinct labels (label) of the training rows."""
    return df.where(F.col(split) == train).select(F.explode(labels).alias("label")).distinct()


def unseen_counts(df: DataFrame, labels: str, known: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Per split, units and those with a label that training lacks."""
    flat = df.select(split, key, F.explode_outer(labels).alias("label"))
    missed = flat.join(known.withColumn("known", F.lit(True)), "label", "left").groupBy(split, key).agg(F.max((F.col("known").isNull() & F.col("label").isNotNull()).cast("int")).alias("m"))
    return missed.groupBy(split).agg(F.count("*").alias("units"), F.sum("m").alias("unseen"))


def reason_counts(df: DataFrame, reason: str, known: list[str]) -> DataFrame:
    """Rows by reason, with zero for known reasons that don't occur."""
    base = df.sparkSession.createDataFrame([(k,) for k in known], f"{reason} string")
    n = df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))
    return base.join(n, reason, "full").select(reason, F.coalesce("n", F.lit(0)).alias("n"))


def groups_in_two_splits(df: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups that break the rule of one split each."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def first_groups(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """All rows of the n groups that appear first."""
    first = df.groupBy(group).agg(F.min(order).alias("__at")).orderBy("__at", group).limit(n)
    return df.join(F.broadcast(first.drop("__at")), group, "left_semi")  # n rows at most


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order; each task keeps n at most."""
    return df.orderBy(*order).limit(n)
