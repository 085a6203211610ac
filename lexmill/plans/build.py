"""Sources to processed records: split plan over all sources, then one pass that redacts, extracts and writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import presets
from ..functions.columns import content_key
from ..operators import factors, redact, splits
from ..sources import jsonl
from ..sources.sinks import write_by_split


def read_cases(spark: SparkSession, paths: dict[str, str], dataset: str, limit: int | None = None) -> DataFrame:
    """All splits' cases with their content keys; limit counts lines of each split."""
    out = None
    for split, path in paths.items():
        if dataset == "cail":
            rows = jsonl.read_json_lines(spark, path, jsonl.SIMPLE)
            part = jsonl.simple_cases(rows if limit is None else rows.where(F.col("line_no") <= limit), split)
        else:
            rows = jsonl.lines(spark, path).where(F.trim("value") != "")
            part = jsonl.joint_cases(rows if limit is None else rows.where(F.col("line_no") <= limit), split)
        out = part if out is None else out.unionByName(part)
    line = F.regexp_extract("source_path", ":([0-9]+)$", 1).cast("long")
    return out.withColumn("key", content_key("fact_raw")).withColumn("line_no", line)


def build(spark: SparkSession, paths: dict[str, str], dataset: str, output: str, limit: int | None = None, near: bool = True) -> dict:
    """Write ``<output>/records`` by split and ``<output>/metadata``; returns the metadata.

    The label vocabulary comes from training clusters only and must be known before anything is redacted, so
    the plan is one job and the records another. What is collected are vocabularies and counts."""
    cases = read_cases(spark, paths, dataset, limit)
    plan = splits.split_plan(cases, dataset, "fact_raw", near=near).persist()
    of_train = cases.where("split = 'train'").join(plan.where("assigned = 'train'").select("key"), "key", "left_semi")
    charges, articles = (sorted(r[0] for r in of_train.select(F.explode(c)).distinct().collect()) for c in ("charges", "conviction_articles"))
    names = redact.lexicon_names(of_train.select(F.explode("charges").alias("charge")), "charge")
    kept = splits.first_of_each(splits.reassign(cases.withColumnRenamed("group_id", "source_group_id"), plan), ["split", "case_id"], ["line_no", "case_id"])
    texts = redact.redact(kept, "fact_raw", names, keep=[c for c in kept.columns if c != "fact_raw"])
    records = factors.with_factors(texts).drop("key", "line_no")
    write_by_split(records, f"{output}/records")
    done = spark.read.parquet(f"{output}/records")
    counts = splits.drop_counts(cases, plan)
    word = lambda labels: F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    unseen = done.groupBy("split").agg(
        F.count("*").alias("units"), F.count_if(F.size(F.array_except("charges", word(charges))) > 0).alias("charge"), F.count_if(F.size(F.array_except("conviction_articles", word(articles))) > 0).alias("article")
    ).collect()
    drops = {r["split"]: r for r in counts.collect()}
    reasons = done.select(F.explode(F.array_compact(F.array("penalty_exclusion", "penalty_fallback"))).alias("reason"))
    known = ["missing_final_penalty", "missing_penalty_fields", "unusable_final_penalty_fallback"]
    wide = plan.select("cluster", "n_splits").distinct().agg(F.count_if(F.col("n_splits") > 1)).first()[0]
    metadata = {
        "dataset": dataset, "split_units": {r["split"]: r["units"] for r in unseen},
        "split_integrity": {
            "assignment_policy": "prefer_test_then_valid_then_train", "grouping": "normalized_fact_and_minhash" if near else "normalized_fact", "near_duplicate_threshold": 0.9, "cross_split_groups": wide,
            "dropped_units": {k: r["dropped"] for k, r in drops.items()}, "duplicate_case_ids_dropped": {k: r["repeated_ids"] for k, r in drops.items()},
        },
        "label_vocabulary_source": "train", "label_coverage": {r["split"]: {"units_with_unseen_charge": r["charge"], "units_with_unseen_article": r["article"]} for r in unseen},
        "sanitizer": {"version": "v3", "charge_lexicon": names}, "charge_vocabulary": charges, "article_vocabulary": articles, "penalty_vocabulary": presets.PENALTIES,
        "penalty_label_exclusions": {r["reason"]: r["n"] for r in splits.reason_counts(reasons, "reason", known).collect()},
    }
    spark.createDataFrame([(json.dumps(metadata, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/metadata")
    jsonl.manifest(spark, list(paths.values())).write.mode("overwrite").parquet(f"{output}/manifest")
    plan.unpersist()
    return metadata
