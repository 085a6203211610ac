"""Proposals of controlled edits: a same-band amount, a neighbouring charge, a restitution turned round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.columns import rank_exclusion, same_band_amount


def neighbours(charge: Column, boundaries: Sequence[Sequence[str]]) -> Column:
    """Distinct other charges of every boundary group that has this one, in the groups' order."""
    groups = F.array(*[F.array(*[F.lit(c) for c in g]) for g in boundaries])
    near = F.flatten(F.filter(groups, lambda g: F.array_contains(g, charge)))
    return F.array_remove(F.array_distinct(near), charge)


def propose(cases: DataFrame, boundaries: Sequence[Sequence[str]], conduct: dict[str, str] = presets.TARGET_CONDUCT, edges: Sequence[float] = presets.AMOUNT_EDGES) -> DataFrame:
    """Rows of proposals for cases with case_id, target_defendant, charges, factors, co_defendants, penalty_type and imprisonment_months.

    One case gives an invariant edit, flips and a ranking edit, in that order, as far as each is sound."""
    f = F.col("factors")
    label = F.array_join("charges", "+")
    amount = same_band_amount(f["amount"], edges)
    turned = f.withField("restitution", ~f["restitution"])
    kind = lambda t, target, charge, direction, fields, rule: F.struct(
        F.lit(t).alias("intervention_type"), target.alias("target_factors"), charge.cast("string").alias("target_charge"),
        direction.cast("int").alias("rank_direction"), F.array(F.lit(fields)).alias("changed_fields"), rule.alias("rule_id"),
    )
    none = F.lit(None)
    invariant = F.when(amount.isNotNull(), kind("invariant", f.withField("amount", amount), none, none, "amount", F.concat(label, F.lit(":amount_same_legal_band"))))
    names = F.create_map(*[x for k, v in conduct.items() for x in (F.lit(k), F.lit(v))])
    targets = F.when(F.size("charges") == 1, neighbours(F.get("charges", F.lit(0)), boundaries)).otherwise(F.array().cast("array<string>"))
    flips = F.transform(targets, lambda c: kind("charge_flip", f.withField("conduct", F.element_at(names, c)), c, none, "conduct", F.concat(F.lit("boundary:"), label, F.lit("->"), c)))
    reason = rank_exclusion("charges", "penalty_type", "imprisonment_months", f["restitution"])
    rank = F.when(reason.isNull(), kind("sentence_rank", turned, none, F.when(f["restitution"], 1).otherwise(-1), "restitution", F.concat(label, F.lit(":restitution_conditional_direction"))))
    every = F.concat(F.array_compact(F.array(invariant)), flips, F.array_compact(F.array(rank)))
    checked = cases.where(F.when(F.size("charges") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("interventions need a charge")).cast("boolean")))
    return checked.select(
        F.col("case_id").alias("parent_case_id"), "target_defendant", F.col("factors").alias("source_factors"), "co_defendants", F.posexplode(every).alias("ord", "x")
    ).select("parent_case_id", "target_defendant", "source_factors", "co_defendants", "ord", "x.*")


def rankable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without ranking rows that aren't eligible, and (reason, n) of those."""
    reason = F.when(F.col("intervention_type") == "sentence_rank", rank_exclusion("charges", "penalty_type", "imprisonment_months", "restitution"))
    marked = rows.withColumn("__reason", reason)
    counts = marked.where(F.col("__reason").isNotNull()).groupBy(F.col("__reason").alias("reason")).agg(F.count("*").alias("n"))
    return marked.where(F.col("__reason").isNull()).drop("__reason"), counts


def rank_reasons(cases: DataFrame) -> DataFrame:
    """(reason, n) of cases that no ranking edit can be made of."""
    reason = rank_exclusion("charges", "penalty_type", "imprisonment_months", F.col("factors.restitution")).alias("reason")
    return cases.select(reason).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def overlaid(pairs: DataFrame, text: str = "counterfactual_text", factors: str = "counterfactual_factors") -> DataFrame:
    """The parents' columns with the edited text in both views and its factors, the parent's where there are none."""
    return pairs.withColumns({"fact_conservative": F.col(text), "fact_strict": F.col(text), "factors": F.coalesce(factors, "factors")})


def known_targets(pairs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Flips only to charges of the training vocabulary."""
    return pairs.where((F.col("intervention_type") != "charge_flip") | F.col("target_charge").isin(list(vocabulary)))


def augmentation(pairs: DataFrame) -> DataFrame:
    """Training rows of edited texts: flips carry their target charge, and no penalty is supervised."""
    flip = F.col("intervention_type") == "charge_flip"
    return pairs.withColumns({
        "charges": F.when(flip, F.array("target_charge")).otherwise(F.col("charges")), "fact_strict": F.col("counterfactual_strict"), "factors": F.col("target_factors"),
        "mask_penalty": F.lit(True), "penalty_type": F.lit("unknown"), "imprisonment_months": F.lit(None).cast("int"),
    })


def allowed(pairs: DataFrame, kinds: list[str]) -> DataFrame:
    """The pairs of these kinds of intervention; that none is left is an error."""
    out = pairs.where(F.col("intervention_type").isin(*kinds)) if kinds else pairs.limit(0)
    if out.isEmpty():
        raise ValueError(f"no pair of the kinds {sorted(kinds)} is left")
    return out
