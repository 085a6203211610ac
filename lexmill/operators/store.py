"""An append-only store of records under ids: resume, views of exactly what was asked, and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import presets

VERSION = "version-"


def pending(requests: DataFrame, stored: DataFrame, key: str = "generation_id") -> DataFrame:
    """Requests that the store lacks, each id once."""
    return requests.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def resume_counts(requests: DataFrame, stored: DataFrame, key: str = "generation_id") -> DataFrame:
    """One row: requested, resumed (already stored), duplicate and new."""
    per = requests.groupBy(key).agg(F.count("*").alias("n")).join(stored.select(key).distinct().withColumn("there", F.lit(1)), key, "left")
    here = F.col("there").isNotNull()
    return per.agg(F.sum("n").alias("requested"), F.count_if(here).alias("resumed"), F.sum(F.col("n") - 1).alias("duplicate"), F.count_if(~here).alias("new"))


def append(records: DataFrame, path: str) -> None:
    """Add records; what is durable is the whole job's output, not a single record."""
    records.write.mode("append").parquet(path)


def view_problems(requests: DataFrame, stored: DataFrame, key: str = "generation_id", same: list[str] = ()) -> DataFrame:
    """Rows (key, problem): ids asked twice, missing, stored twice, or stored with other values than asked."""
    asked = requests.groupBy(key).agg(F.count("*").alias("asked"), *[F.first(c).alias(c) for c in same])
    held = stored.groupBy(key).agg(F.count("*").alias("held"), *[F.min(c).alias(f"s_{c}") for c in same])
    j = asked.join(held, key, "left")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"s_{c}"))
    problem = F.when(F.col("asked") > 1, "duplicate_request").when(F.col("held").isNull(), "missing").when(F.col("held") > 1, "duplicate_record").when(differs, "mismatch")
    return j.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def view(requests: DataFrame, stored: DataFrame, key: str = "generation_id", order: str | None = None, same: list[str] = ()) -> DataFrame:
    """The stored records of exactly the requested ids, or an error that names one problem."""
    bad = view_problems(requests, stored, key, same).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].problem}: {bad[0][0]}")
    asked = requests.select(key, *([F.col(order).alias("__ord")] if order else []))
    out = stored.join(asked, key)
    return out.orderBy("__ord").drop("__ord") if order else out


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, whether it is whole) of the versions below a path, the lowest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    found = [int(n[len(VERSION):]) for n in names if n.startswith(VERSION) and n[len(VERSION):].isdigit()]
    return [(n, fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSION}{n}/_SUCCESS"))) for n in sorted(found)]


def publish(df: DataFrame, path: str, fmt: str = "parquet", keep: int = 2) -> int:
    """Write the table as a version of its own below the path and return its number.

    Nothing is moved or overwritten: a version counts once Spark has written its success marker, so readers (``published``)
    see the old table or the new one, and a failed job changes nothing. The newest ``keep`` whole versions stay for
    readers that have begun. Two publishers at once get the same number, and the second fails."""
    spark = df.sparkSession
    held = _versions(spark, path)
    new = 1 + max((n for n, _ in held), default=0)
    df.write.format(fmt).mode("errorifexists").save(f"{path}/{VERSION}{new}")
    jvm = spark.sparkContext._jvm
    for n in sorted((n for n, whole in held if whole), reverse=True)[keep - 1 :]:
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSION}{n}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return new


def published(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The newest whole version below a path."""
    whole = [n for n, done in _versions(spark, path) if done]
    if not whole:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.format(fmt).load(f"{path}/{VERSION}{whole[-1]}")


def with_parents(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children with their parents' columns; a child without a parent fails the job when its row is reached."""
    p = parents.withColumn("__there", F.lit(True))
    j = children.join(p, children[child_key] == p[parent_key], "left")
    guard = F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no parent: "), F.coalesce(F.col(child_key).cast("string"), F.lit("null")))).cast("boolean"))
    return j.where(guard).drop("__there")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def backfill_parent_labels(rows: DataFrame, parents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Rows with parent_charge_indices filled from the parents where flips lack them."""
    words = F.array(*[F.lit(v) for v in vocabulary])
    idx = F.filter(F.transform("p_charges", lambda c: (F.array_position(words, c) - 1).cast("int")), lambda i: i >= 0)
    need = (F.col("intervention_type") == "charge_flip") & (F.coalesce(F.size("parent_charge_indices"), F.lit(0)) == 0)
    ids = rows.where(need).select("case_id").distinct()
    p = parents.join(ids, "case_id", "left_semi").groupBy("case_id").agg(F.first("charges").alias("p_charges"))
    return rows.join(p, "case_id", "left").withColumn("parent_charge_indices", F.when(need, idx).otherwise(F.col("parent_charge_indices"))).drop("p_charges")


def leaks(errors: Column | str, names: list[str] = presets.LEAKS) -> Column:
    return F.coalesce(F.arrays_overlap(errors, F.array(*[F.lit(n) for n in names])), F.lit(False))


def clean_records(records: DataFrame) -> DataFrame:
    """Valid records without leakage."""
    return records.where(F.col("validation.valid") & ~F.coalesce(F.col("leakage"), F.lit(False)) & ~leaks("validation.errors"))


def same_groups(train: DataFrame, held_out: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups that both have; must be empty."""
    return train.select(group).distinct().join(held_out.select(group).distinct(), group, "left_semi")


def version_gate(records: DataFrame, expected: dict[str, str], raise_: bool = True) -> DataFrame:
    """Records whose versions and identity are current: others raise, or go to ``gate_reason`` for a quarantine table."""
    reason = None
    for field, want in expected.items():
        test = ~F.col(field).eqNullSafe(F.lit(want))
        text = F.concat(F.lit(f"{field} is "), F.coalesce(F.col(field).cast("string"), F.lit("null")), F.lit(f", not {want}"))
        reason = F.when(test, text) if reason is None else reason.when(test, text)
    if not raise_:
        return records.withColumn("gate_reason", reason)
    return records.where(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean")))
