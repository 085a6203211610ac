"""Processed records to requests, realised and validated records in a resumable store, a view and its coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.columns import first_filled, request_id
from ..operators import batches, coverage, edits, interventions, splits, store

VERSIONS = {"prompt_version": "p1", "sanitizer_version": "v3", "validator_version": "clause-scope"}


def parents(records: DataFrame, most_chars: int | None = None) -> DataFrame:
    """Coverage rows of the parents; a long one is flagged and stays in the table."""
    chars = F.length("fact_strict")
    return records.select(
        "case_id", first_filled("group_id", "case_id").alias("case_group_id"), chars.alias("chars"), "charges", (F.size(F.coalesce("co_defendants", F.array().cast("array<string>"))) + 1).alias("defendant_count"),
        (F.lit(False) if most_chars is None else chars > most_chars).alias("length_excluded"),
    )


def requests(records: DataFrame, boundaries: Sequence[Sequence[str]], most_chars: int | None = None, versions: dict[str, str] = VERSIONS, limit: int | None = None, order: str = "case_id") -> DataFrame:
    """Proposals with parent text and generation_id, which holds every version: a new version makes new requests.

    A limit keeps the first proposals in the order of their parents, so it can cut a parent's proposals part-way."""
    usable = records if most_chars is None else records.where(F.length("fact_strict") <= most_chars)
    made = interventions.propose(usable, boundaries)
    text = usable.select(F.col("case_id").alias("parent_case_id"), F.col("target_defendant").alias("__t"), F.col("fact_strict").alias("parent_text"), F.col(order).alias("__at"))
    j = made.join(text, (made["parent_case_id"] == text["parent_case_id"]) & (made["target_defendant"] == text["__t"])).drop(text["parent_case_id"]).drop("__t")
    ids = request_id("parent_case_id", "target_defendant", F.concat_ws("\n", "co_defendants"), "rule_id", F.sha2("parent_text", 256), *[F.lit(v) for v in versions.values()])
    out = j.withColumn("generation_id", ids).withColumns({k: F.lit(v) for k, v in versions.items()})
    return (out if limit is None else splits.first_rows(out, ["__at", "parent_case_id", "ord"], limit)).drop("__at")


def mock_sentence(quote: Column, source: Column, target: Column) -> Column:
    """A stand-in for a language model: the source's longest cue swapped for the target's first one."""
    first = F.coalesce(*[F.when(target == n, c[0]) for n, c in presets.CONDUCT], target)
    body = F.regexp_replace(quote, f"[{edits.ENDS}]+$", "")
    swapped = F.lit(None).cast("string")
    for name, cues in presets.CONDUCT:
        own = F.lit(None).cast("string")
        for cue in sorted(cues, key=len):
            own = F.when(body.contains(cue), F.concat(F.substring_index(body, cue, 1), first, F.expr(f"substring({'`__body`'}, instr(`__body`, '{cue}') + {len(cue)})"))).otherwise(own)
        swapped = F.when(source == name, own).otherwise(swapped)
    return F.concat(F.coalesce(swapped, F.concat(body, F.lit("，其行为表现为"), first)), F.lit("。"))


def realise(pending: DataFrame, writer: Callable[[Column, Column, Column], Column] = mock_sentence) -> DataFrame:
    """Records of requests: planned, edited or written, and validated. Skips keep their reason.

    The writer makes the new sentence, a column, of columns (quote, source conduct, target conduct): built-in functions, or
    a pandas UDF that asks a model. What it returns is validated like any other edit."""
    spec = F.struct("target_defendant", "co_defendants", "changed_fields", "source_factors", "target_factors", "target_charge")
    planned = edits.plan(pending.withColumn("spec", spec), "parent_text")
    ready = planned.withColumn("__body", F.regexp_replace("plan.quote", f"[{edits.ENDS}]+$", ""))
    written = ready.withColumn("__new", F.when(F.col("plan.kind") == "span", writer(F.col("plan.quote"), F.col("source_factors.conduct"), F.col("target_factors.conduct"))))
    text = F.when(F.col("plan.kind") == "span", edits.splice(F.col("plan.text"), F.col("plan.start"), F.col("plan.start") + F.length("plan.quote"), F.col("__new"))).otherwise(F.col("plan.text"))
    done = written.withColumn("counterfactual_text", text).withColumn("similarity", batches.similarity("parent_text", "counterfactual_text"))
    out = edits.validate(done, "parent_text", "counterfactual_text", out="v")
    skip = F.col("plan.kind") == "skip"
    errors = F.when(skip, F.array("plan.reason")).otherwise(F.col("v.errors"))
    out = out.withColumn("validation", F.struct((F.col("v.valid") & ~skip).alias("valid"), errors.alias("errors"), F.col("v.novel_ratio").alias("novel_ratio"), F.col("similarity").alias("similarity")))
    return out.withColumns({"realization": F.col("plan.kind"), "realization_reason": F.col("plan.reason"), "leakage": store.leaks("validation.errors")}).drop("spec", "plan", "v", "__body", "__new", "similarity", "ord")


def run(records: DataFrame, boundaries: Sequence[Sequence[str]], store_path: str, view_path: str, most_chars: int | None = None, limit: int | None = None, writer: Callable[[Column, Column, Column], Column] = mock_sentence) -> dict[str, DataFrame]:
    """Resume the store, publish the view of exactly these requests, and report coverage; its part on generation counts the view's records. Running it again adds nothing."""
    spark = records.sparkSession
    asked = requests(records, boundaries, most_chars, limit=limit)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(store_path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    todo = store.pending(asked, spark.read.parquet(store_path)) if there else asked.dropDuplicates(["generation_id"])
    store.append(realise(todo, writer), store_path)
    held = spark.read.parquet(store_path)
    store.publish(store.view(asked.dropDuplicates(["generation_id"]), held), view_path)
    seen = store.published(spark, view_path)
    # from what is stored: proposals and edits aren't made again
    meta = seen.select("generation_id", F.col("parent_case_id").alias("case_id")).join(parents(records).dropDuplicates(["case_id"]), "case_id")
    report = coverage.report(parents(records, most_chars), interventions.rank_reasons(records), seen, view=(meta, seen))
    return {"report": report, "parents": coverage.parent_table(parents(records, most_chars)), "excluded": coverage.length_exclusion(parents(records, most_chars)), "reasons": coverage.validation_reasons(seen), "view": seen}
