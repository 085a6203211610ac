"""Coverage of parents and requests, each count at its declared unit. Long tables: (part, name, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import length_bucket


def case_sizes(parents: DataFrame, group: str = "case_group_id", size: str = "defendant_count") -> DataFrame:
    """Each case's declared size: the largest that one of its records states."""
    return parents.groupBy(group).agg(F.max(size).alias("size"))


def parent_table(parents: DataFrame, group: str = "case_group_id") -> DataFrame:
    """Counts of records and cases, by length bucket, charge and case size."""
    row = lambda part, name: F.struct(F.lit(part).alias("part"), name.cast("string").alias("name"))
    facts = F.concat(
        F.array(row("count", F.lit("defendant_record")), row("length_bucket", length_bucket("chars"))),
        F.transform(F.coalesce("charges", F.array().cast("array<string>")), lambda c: row("charge", c)),
    )
    by_record = parents.select(F.explode(facts).alias("x")).select("x.*")
    by_case = case_sizes(parents, group).select(F.explode(F.array(row("count", F.lit("case")), row("defendants_per_case", F.col("size")))).alias("x")).select("x.*")
    return by_record.unionByName(by_case).groupBy("part", "name").agg(F.count("*").alias("n"))


def length_exclusion(parents: DataFrame, group: str = "case_group_id") -> DataFrame:
    """One row: excluded records, cases that lost one, and cases of which another record stays."""
    per = parents.groupBy(group).agg(F.count_if("length_excluded").alias("out"), F.count_if(~F.col("length_excluded")).alias("stay"))
    return per.agg(F.coalesce(F.sum("out"), F.lit(0)).alias("excluded"), F.count_if(F.col("out") > 0).alias("affected_cases"), F.count_if((F.col("out") > 0) & (F.col("stay") > 0)).alias("partial_cases"))


def validation_reasons(records: DataFrame) -> DataFrame:
    """(reason, n) of records that aren't valid; without an error the reason is ``invalid``."""
    errors = F.when(F.coalesce(F.size("validation.errors"), F.lit(0)) > 0, F.col("validation.errors")).otherwise(F.array(F.lit("invalid")))
    bad = records.where(~F.coalesce(F.col("validation.valid"), F.lit(False)))
    return bad.select(F.explode(errors).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def generation_totals(records: DataFrame, resumed: int, duplicate: int, failures: int) -> DataFrame:
    good = F.count_if(F.coalesce(F.col("validation.valid"), F.lit(False)))
    n = F.count("*")
    return records.agg(n.alias("new"), F.lit(resumed).alias("resumed"), F.lit(duplicate).alias("duplicate"), (n + resumed).alias("current_total"), good.alias("passed"), (n - good).alias("failed_validation"), F.lit(failures).alias("transport_failures"))


def last_requests(requests: DataFrame, rows: DataFrame, key: str = "generation_id", order: str | None = None) -> DataFrame:
    """One request of each defendant that the rows have: the last by order, else by key."""
    last = Window.partitionBy("case_id").orderBy(F.desc(order or key))
    return requests.join(rows.select(key).distinct(), key, "left_semi").withColumn("__last", F.row_number().over(last)).where("__last = 1").drop("__last")


def view_totals(requests: DataFrame, rows: DataFrame, key: str = "generation_id", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, passed, failed_validation) of a view, and the parent table of its distinct defendants: of a defendant's requests the last by order (else by key) counts."""
    good = F.count_if(F.coalesce(F.col("validation.valid"), F.lit(False)))
    parents = last_requests(requests, rows, key, order)
    return rows.agg(F.count("*").alias("records"), good.alias("passed"), (F.count("*") - good).alias("failed_validation")), parent_table(parents)


def _counts(df: DataFrame, name: str, when: Column | None = None) -> Column:
    """A map of a small table (name, n), its keys in order."""
    row = F.struct(F.col(name).alias("k"), F.col("n").alias("v"))
    return F.map_from_entries(F.array_sort(F.collect_list(row if when is None else F.when(when, row))))


def _parents(parents: DataFrame) -> DataFrame:
    t = parent_table(parents)
    part = F.col("part")
    one = lambda name: F.coalesce(F.max(F.when((part == "count") & (F.col("name") == name), F.col("n"))), F.lit(0))
    kinds = {"length_buckets": "length_bucket", "charges": "charge", "defendants_per_case": "defendants_per_case"}
    return t.agg(one("defendant_record").alias("count"), one("case").alias("case_count"), *[_counts(t, "name", part == p).alias(k) for k, p in kinds.items()])


def _reasons(records: DataFrame) -> DataFrame:
    """Reasons by their code alone: who a code names is left out, so their number doesn't grow with the names."""
    by_code = validation_reasons(records).groupBy(F.regexp_replace("reason", "^(non_target_defendant_changed):.*", "$1").alias("code")).agg(F.sum("n").alias("n"))
    return by_code.agg(_counts(by_code, "code").alias("excluded_reasons"))


def report(parents: DataFrame, rank_exclusions: DataFrame, records: DataFrame, resumed: int = 0, duplicate: int = 0, failures: int = 0, view: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row of nested counts (parents, generation, and view where (requests, rows) of one is given), each at its unit.

    Its maps hold a row a length bucket, charge, case size or reason."""
    fold = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    own = _parents(parents).crossJoin(length_exclusion(parents)).crossJoin(rank_exclusions.agg(_counts(rank_exclusions, "reason").alias("rank_exclusions")))  # one row each
    made = generation_totals(records, resumed, duplicate, failures).crossJoin(_reasons(records))
    out = fold(own, "parents").crossJoin(fold(made, "generation"))
    if view is None:
        return out
    requests, rows = view
    totals, _ = view_totals(requests, rows)
    return out.crossJoin(fold(totals.crossJoin(_parents(last_requests(requests, rows)).drop("count")).crossJoin(_reasons(rows)), "view"))
