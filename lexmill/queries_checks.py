"""Queries of samples, evaluation payloads, drifts and checked edits over the driver tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import edits, factors, losses, metrics
from .plans import evaluate
from .queries import query, table
from .queries_cases import FACTS, told
from .queries_stats import LEVEL_COLUMNS, LEVELS, SCORED, level_rows, rounded, scored


@query("a25_reservoir")
def a25_reservoir(spark, sf_dir):
    return metrics.reservoir_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 100)


@query("p10_request_ids", "SELECT o_orderkey, substr(sha256(o_orderkey || chr(0) || o_orderstatus || chr(0) || chr(0) || o_orderpriority), 1, 24) AS request_id FROM orders")
def p10(spark, sf_dir):
    """A null between two fields keeps its place."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.request_id(F.col("o_orderkey"), F.col("o_orderstatus"), none, F.col("o_orderpriority")).alias("request_id"))


@query("k10_payload", f"""
    WITH {LEVELS}, m AS (SELECT {LEVEL_COLUMNS} FROM g)
    SELECT 'cmdl' AS kind, 20::BIGINT AS iterations, 'group_id' AS cluster_key, defendant_charge_accuracy, case_full_accuracy, case_count, case_charge_accuracy AS estimate, true AS inside FROM m""")
def k10(spark, sf_dir):
    """The payload is read back as JSON: metrics over all rows, estimates equal to them, and intervals around them."""
    p = evaluate.payload(level_rows(spark, sf_dir), "cmdl", 20, 7, bucket=F.pmod("group_id", F.lit(16)))
    at = lambda path, kind: F.get_json_object("payload", f"$.{path}").cast(kind)
    own, spread = at("metrics.case_charge_accuracy", "double"), "confidence_intervals.case_charge_accuracy"
    return rounded(p.select(
        at("kind", "string").alias("kind"), at("bootstrap.iterations", "bigint").alias("iterations"), at("bootstrap.cluster_key", "string").alias("cluster_key"),
        at("metrics.defendant_charge_accuracy", "double").alias("defendant_charge_accuracy"), at("metrics.case_full_accuracy", "double").alias("case_full_accuracy"), at("metrics.case_count", "bigint").alias("case_count"),
        at(f"{spread}.estimate", "double").alias("estimate"), ((at(f"{spread}.lower", "double") <= own) & (own <= at(f"{spread}.upper", "double"))).alias("inside"),
    ))


@query("a20_static_metrics", f"""
    WITH {SCORED}, k AS (SELECT *, vec_id % 50 AS t, label AS q2, list_sum(truth) = 1 AS single FROM h),
         b AS (SELECT *, CASE WHEN t <= 6 THEN 0 WHEN t <= 12 THEN 1 WHEN t <= 24 THEN 2 WHEN t <= 36 THEN 3 ELSE 4 END = CASE WHEN q2 <= 6 THEN 0 WHEN q2 <= 12 THEN 1 WHEN q2 <= 24 THEN 2 WHEN q2 <= 36 THEN 3 ELSE 4 END AS same FROM k)
    SELECT (SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) FROM c) AS charge_micro_f1,
           (SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) FILTER (WHERE tp + fn > 0), 9) FROM c) AS charge_macro_f1,
           round(avg(CASE WHEN hot = truth THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS charge_accuracy, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS sentence_accuracy,
           count(*) FILTER (WHERE single) AS sentence_eligible_count, round(avg(abs(t - q2)) FILTER (WHERE single), 9)::DOUBLE AS sentence_mae,
           round(avg(CASE WHEN abs(t - q2) <= 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE single), 9)::DOUBLE AS sentence_tolerance_accuracy FROM b""")
def a20(spark, sf_dir):
    """Charges, penalty classes and months in one set; months count for rows of one true charge."""
    none = F.array().cast("array<string>")
    hot = C.thresholded("p", 0.15)
    rows = scored(spark, sf_dir).select(
        F.col("truth").alias("true_charges"), hot.alias("predicted_charges"), none.alias("unseen_true_charge_labels"), F.col("truth").alias("true_articles"), hot.alias("predicted_articles"),
        none.alias("unseen_true_article_labels"), F.lit("fixed_term").alias("penalty_type"), F.lit("fixed_term").alias("predicted_penalty_type"), (F.col("vec_id") % 50).cast("double").alias("true_months"),
        F.col("label").cast("double").alias("predicted_months"),
    )
    kept = ("charge_micro_f1", "charge_macro_f1", "charge_accuracy", "sentence_accuracy", "sentence_eligible_count", "sentence_mae", "sentence_tolerance_accuracy")
    return rounded(evaluate.static_metrics(rows).select(*kept))


@query("t38_pair_drifts", f"""
    WITH {SCORED}, k AS (SELECT *, list_max(list_transform(p, lambda x, i: abs(x - q[i]))) AS drift, p[1] * 100 AS a, q[1] * 100 AS b FROM e)
    SELECT vec_id, round(drift, 9) AS charge_drift, CASE WHEN list_position(p, list_max(p)) <> list_position(q, list_max(q)) OR drift > 0.25 THEN 1.0 ELSE 0.0 END::DOUBLE AS violation,
           round(abs(b - a) / greatest(a, 1.0), 9) AS sentence_drift FROM k""")
def t38(spark, sf_dir):
    """Every pair's largest drift, whether its first place moved, and its months' relative drift."""
    rows = scored(spark, sf_dir).select(
        "vec_id", F.lit("invariant").alias("intervention_type"), F.lit(0).alias("target_charge"), F.array().cast("array<int>").alias("parent_charge_indices"), F.lit(None).cast("double").alias("charge_threshold"),
        F.lit(1).alias("rank_direction"), F.col("p").alias("parent_charge_probabilities"), F.col("q").alias("counterfactual_charge_probabilities"),
        (F.get("p", F.lit(0)) * 100).alias("parent_sentence"), (F.get("q", F.lit(0)) * 100).alias("counterfactual_sentence"),
    )
    v = metrics.counterfactual_values(rows, 0.25)
    return rounded(v.select("vec_id", F.col("invariant_charge_drift").alias("charge_drift"), F.col("invariant_violation").alias("violation"), F.col("invariant_sentence_drift").alias("sentence_drift")))


@query("l05_invariant_loss", f"""
    WITH {SCORED}, s AS (SELECT vec_id, list_sum(list_transform(p, lambda x, i: (x - q[i]) * (x - q[i]))) AS shift FROM e)
    SELECT round(coalesce(avg(shift) FILTER (WHERE vec_id % 3 = 1), 0), 9) AS invariant, count(*) FILTER (WHERE vec_id % 3 = 1) AS n_invariant, round(0.5 * coalesce(avg(shift) FILTER (WHERE vec_id % 3 = 1), 0), 9) AS total FROM s""")
def l05(spark, sf_dir):
    """The mean over invariant pairs alone, weighted into the total."""
    e = scored(spark, sf_dir)
    out = losses.typed_losses(e, {"invariant": [(losses.invariant_shift("p", "q"), F.col("vec_id") % 3 == 1)]}, {"invariant": 0.5})
    return rounded(out.select("invariant", "n_invariant", "total"))


BODY = "translate(coalesce(text, ''), '.,;!?', '。，；！？')"
RESTS = " ".join(f"WHEN {k} THEN '{f.removeprefix('甲某在场。')}'" for k, f in enumerate(FACTS))


@query("t22_restitution_edits", f"""
    WITH d AS (SELECT doc_id, {BODY} || chr(10) AS body, doc_id % 8 AS k, '甲某' || CASE WHEN doc_id % 3 = 0 THEN '案发后未退赃退赔' ELSE '案发后已退赃退赔' END AS c FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN body || CASE k WHEN 1 THEN '甲某在场。' || c || '。' WHEN 2 THEN '甲某在场。' || c || '，而且自首。' ELSE '甲某在场，' || c || '。' || CASE k {RESTS} END END END AS edited FROM d""")
def t22(spark, sf_dir):
    """The target's own clause of restitution is rewritten; without one the fact follows their first clause. Nothing is asked of every fifth document."""
    wanted = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 3 != 0)
    t = told(spark, sf_dir).withColumn("spans", edits.scope(F.col("text"), F.col("target"), F.col("co")))
    return t.select("doc_id", edits.restitution_edit(F.col("text"), F.col("spans"), F.col("target"), F.col("co"), wanted).alias("edited"))


def below(spark: SparkSession, sf_dir: str, facts: list[str]) -> DataFrame:
    """Every document with one of some facts below its whole text: (doc_id, k, body, text, target, co)."""
    k = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(facts))).cast("int")
    body = F.concat(F.translate(F.coalesce("text", F.lit("")), ".,;!?", "。，；！？"), F.lit("\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", k.alias("k"), body.alias("body"))
    return d.select("*", F.concat("body", F.get(F.array(*[F.lit(f) for f in facts]), F.col("k"))).alias("text"), F.lit("甲某").alias("target"), F.array(F.lit("乙某")).alias("co"))


# one deed, two deeds, a summary, a bare initial, somebody else's deed
DEEDS = ["甲某窃取手机。", "甲某窃取手机。甲某又窃取钱包。", "甲某盗窃作案3次。", "当日，甲持刀窃取手机。", "乙某窃取手机。"]


@query("t25_flip_spans", f"""
    WITH d AS (SELECT doc_id, length({BODY}) + 1 AS n, doc_id % 5 AS k FROM documents)
    SELECT doc_id, CASE WHEN k = 0 THEN '{DEEDS[0]}' ELSE '-' END AS quote, CASE WHEN k = 0 THEN n ELSE -1 END AS start, CASE k WHEN 0 THEN '-' WHEN 1 THEN 'incomplete_flip' WHEN 3 THEN 'abbreviated_ambiguous' ELSE 'no_target_span' END AS reason FROM d""")
def t25(spark, sf_dir):
    """The one sentence that a flip would rewrite and where it is in a whole document, or why there is none."""
    f = edits.flip_span(below(spark, sf_dir, DEEDS), "text", F.col("target"), F.col("co"), F.lit("秘密窃取"))
    return f.select("doc_id", F.coalesce("__flip.s", F.lit("-")).alias("quote"), F.coalesce("__flip.start", F.lit(-1)).cast("bigint").alias("start"), F.coalesce("__flip.reason", F.lit("-")).alias("reason"))


# right, unchanged, one's own other factor, another person's factor, another person alone, talk of a sentence
RESULTS = [
    ("甲某在场。甲某案发后已退赃退赔。", ""), ("甲某在场。甲某未退赃。", "target_change_missing,unchanged,factor_mismatch:restitution"), ("甲某在场。甲某案发后已退赃退赔。甲某自首。", "non_target_changed:surrender"),
    ("甲某在场。甲某案发后已退赃退赔。乙某自首。", "non_target_defendant_changed:乙某"), ("乙某在场。乙某案发后已退赃退赔。", "identity_not_preserved,target_change_missing,factor_mismatch:restitution,non_target_defendant_changed:乙某"),
    ("甲某在场。甲某案发后已退赃退赔，可以从轻。", "sentence_leakage"),
]


@query("t28_t30_t31_validated_edits", f"""
    SELECT doc_id, k = 0 AS valid, CASE k {' '.join(f"WHEN {k} THEN '{e}'" for k, (_, e) in enumerate(RESULTS))} END AS errors FROM (SELECT doc_id, doc_id % 6 AS k FROM documents)""")
def t28(spark, sf_dir):
    """What an asked change of restitution may and may not move: the target's other factors, other persons', names, outcome talk."""
    t = below(spark, sf_dir, [r for r, _ in RESULTS]).withColumn("parent", F.concat("body", F.lit("甲某在场。甲某未退赃。")))
    t = factors.with_factors(t, "parent", "target", "co", "source_factors").withColumn("target_factors", F.col("source_factors").withField("restitution", F.lit(True)))
    spec = F.struct(F.col("target").alias("target_defendant"), F.col("co").alias("co_defendants"), F.array(F.lit("restitution")).alias("changed_fields"), "source_factors", "target_factors", F.lit(None).cast("string").alias("target_charge"))
    out = edits.validate(t.withColumn("spec", spec).withColumn("similarity", F.lit(0.9)), "parent", "text")
    return out.select("doc_id", F.col("validation.valid").alias("valid"), F.array_join("validation.errors", ",").alias("errors"))


@query("f13_observed_factors", """
    WITH d AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 3 = 0 OR doc_id % 8 = 2 AS seen FROM documents)
    SELECT doc_id, seen, CASE WHEN seen AND k = 2 THEN 'true' WHEN seen AND k = 1 THEN 'false' ELSE '-' END AS restitution, CASE WHEN seen AND k = 2 THEN 'true' WHEN seen AND k = 6 THEN 'false' ELSE '-' END AS surrender FROM d""")
def f13(spark, sf_dir):
    """Factors are observed where the text shows the change that was asked for; every third document was asked for none."""
    t = factors.with_factors(told(spark, sf_dir), "text", "target", "co", "f").withColumn("target_factors", F.col("f").withField("restitution", F.lit(True)))
    asked = t.withColumn("changed_fields", F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("restitution"))))
    out = factors.observed(asked, "text", target="target", co="co")
    o = F.col("observed_factors")
    return out.select("doc_id", o.isNotNull().alias("seen"), *[F.coalesce(o[c].cast("string"), F.lit("-")).alias(c) for c in ("restitution", "surrender")])
