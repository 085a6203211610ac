"""Prediction rows to metrics with intervals, and paired tests with corrected p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, sentence_class
from ..operators import bootstrap, metrics
from ..operators.components import cut

# The endpoints that are tested by default, five at most.
ENDPOINTS = {
    "static": ["charge_macro_f1", "article_macro_f1", "sentence_macro_f1", "sentence_mae", "sentence_tolerance_accuracy"],
    "counterfactual": ["flip_accuracy", "invariant_violation_rate", "sentence_pairwise_accuracy", "invariant_charge_drift"],
    "cmdl": ["defendant_charge_accuracy", "case_charge_accuracy"],
}


def _joined(parts: list[DataFrame], by: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.crossJoin(p)  # one row by one row
    return out


def _single() -> Column:
    """Whether a row has one true charge, seen or unseen."""
    return F.aggregate("true_charges", F.lit(0), lambda s, x: s + x) + F.size(F.coalesce("unseen_true_charge_labels", F.array().cast("array<string>"))) == 1


def _classes() -> tuple[Column, Column]:
    return sentence_class("penalty_type", "true_months"), sentence_class(F.coalesce("predicted_penalty_type", "penalty_type"), "predicted_months")


def static_metrics(rows: DataFrame, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """Charges, articles, penalty classes and months of weighted rows, one row per value of by."""
    by = list(by)
    parts = []
    for name in ("charge", "article"):
        own = rows.where(F.col(f"true_{name}s").isNotNull())
        args = (f"true_{name}s", f"predicted_{name}s", f"unseen_true_{name}_labels", weight, by)
        both = _joined([metrics.label_metrics(metrics.label_counts(own, *args), by), metrics.row_agreement(own, *args)], by)
        parts.append(both.select(*by, *[F.col(c).alias(f"{name}_{c}") for c in both.columns if c not in by]))
    kinds = metrics.class_metrics(rows, *_classes(), None, weight, by)
    months = metrics.month_metrics(rows, "predicted_months", "true_months", (F.col("penalty_type") == "fixed_term") & _single(), 3.0, weight, by)
    for m in (kinds, months):
        parts.append(m.select(*by, *[F.col(c).alias(f"sentence_{c}") for c in m.columns if c not in by]))
    return _joined(parts, by)


def require_article_labels(rows: DataFrame) -> None:
    """Refuse rows whose article labels are missing: they aren't rows without articles."""
    if "articles_available" not in rows.columns:
        raise ValueError("the rows don't say whether their articles are available")
    if missing := rows.where(~F.coalesce(F.col("articles_available"), F.lit(False))).count():
        raise ValueError(f"{missing} rows have no article labels")


def metrics_of(rows: DataFrame, kind: str, group: str = "group_id") -> DataFrame:
    """One row of the kind's metrics over all rows."""
    if kind == "static":
        return static_metrics(rows)
    return metrics.counterfactual_metrics(rows, 0.1) if kind == "counterfactual" else metrics.case_metrics(metrics.case_levels(rows, group))


def _places(kind: str, places: Column) -> Column:
    """Places of one kind of label that are true or predicted, named by the kind; none where the truth is missing."""
    used = F.filter(places, lambda x: (x["t"] == 1) | (x["p"] == 1))
    named = F.transform(used, lambda x: F.struct(F.lit(kind).alias("kind"), x["label"].alias("label"), x["t"].alias("t"), x["p"].alias("p")))
    return F.coalesce(named, F.array().cast("array<struct<kind:string,label:string,t:int,p:int>>"))


def _static_replicates(rows: DataFrame, weights: DataFrame, group: str) -> DataFrame:
    """Two tables meet the weights: a row of sums a group, and a row a group and label that occurs in it, penalty classes among the labels."""
    single, labels = (F.col("penalty_type") == "fixed_term") & _single(), ("charge", "article")
    sums = {f"sentence_{k}": v for k, v in metrics.month_sums("predicted_months", "true_months", single).items()}
    for n in labels:
        sums |= {f"{n}_{k}": v for k, v in metrics.agreement_sums(f"true_{n}s", f"predicted_{n}s", f"unseen_true_{n}_labels").items()}
    total = {k: F.sum(F.col("weight") * F.col(k)) for k in sums}
    of = lambda n: {k.removeprefix(f"{n}_"): v for k, v in total.items() if k.startswith(f"{n}_")}
    out = {f"sentence_{k}": v for k, v in metrics.month_ratios(of("sentence")).items()}
    for n in labels:
        out |= {f"{n}_accuracy": ratio(of(n)["exact"], of(n)["n"]), f"{n}_hamming_accuracy": ratio(of(n)["same"], of(n)["n"])}
    per_group = rows.groupBy(group).agg(*[v.alias(k) for k, v in sums.items()])
    wide = per_group.join(weights, group).groupBy("rep").agg(*[v.alias(k) for k, v in out.items()])

    truth, guess = _classes()
    one = lambda label, t, p: F.struct(label.alias("label"), F.lit(t).alias("t"), F.lit(p).alias("p"))
    classes = F.when(truth == guess, F.array(one(truth, 1, 1))).otherwise(F.array(one(truth, 1, 0), one(guess, 0, 1)))
    places = F.concat(_places("sentence", classes), *[_places(n, metrics.label_places(f"true_{n}s", f"predicted_{n}s", f"unseen_true_{n}_labels")) for n in labels])
    flat = rows.select(group, F.explode(places).alias("x")).select(group, "x.*")
    t, p = F.col("t"), F.col("p")
    cells = flat.groupBy(group, "kind", "label").agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"))
    drawn = cells.join(weights, group).groupBy("rep", "kind", "label").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    long = metrics.label_metrics(drawn, ["rep", "kind"])
    names = {n: [c for c in long.columns if c not in ("rep", "kind") and not c.endswith("_all_labels")] for n in labels}
    names["sentence"] = ["macro_precision", "macro_recall", "macro_f1"]
    take = lambda n, c: F.coalesce(F.max(F.when(F.col("kind") == n, F.col(c))), F.lit(0.0)).alias(f"{n}_{c}")  # noqa: E731  # ratios over nothing are zero
    # of classes each row has one true: the share of them that is found is the accuracy
    found = F.coalesce(F.max(F.when(F.col("kind") == "sentence", F.col("micro_recall"))), F.lit(0.0)).alias("sentence_accuracy")
    return wide.join(long.groupBy("rep").agg(found, *[take(n, c) for n, cs in names.items() for c in cs]), "rep")


def replicates(rows: DataFrame, kind: str, weights: DataFrame, group: str = "group_id") -> DataFrame:
    """One row of metrics per replicate, from sums per group that meet their group's weight: no row is resampled.

    Labels count per replicate, as macro averages need their support in each; of a group only the labels that occur
    in it are kept, so averages over all labels, present or not, are no columns here."""
    if kind == "static":
        return _static_replicates(rows, weights, group)
    if kind == "counterfactual":
        return metrics.counterfactual_ratios(metrics.counterfactual_sums(rows, 0.1, None, [group]).join(weights, group), "weight", ["rep"])
    return metrics.case_metrics(metrics.case_levels(rows, group).join(weights, group), ["rep"], "weight")


def _long(df: DataFrame, names: list[str], value: str) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(value)) for n in names])).alias("x")).select("x.*")


def endpoints_of(kind: str, names: list[str] | None = None) -> list[str]:
    """The endpoints to test: one to five metrics."""
    chosen = ENDPOINTS[kind] if names is None else list(names)
    if not 1 <= len(chosen) <= 5:
        raise ValueError("one to five endpoints are tested")
    return chosen


def _levels(rows: DataFrame, kind: str) -> DataFrame | None:
    """A checkpoint of the groups' levels, a row of sums each, where the kind's metrics are ratios of these; else None."""
    return None if kind in ("static", "counterfactual") else cut(metrics.case_levels(rows).withColumn("cases", F.lit(1)))


def _drawn_cases(levels: DataFrame, iterations: int, seed: int) -> DataFrame:
    """The rows of ``replicates`` from levels, drawn where the groups are: no table of weights, a row a replicate and task is shuffled."""
    columns = [c for c in levels.columns if c != "group_id"]
    return bootstrap.drawn_sums(levels, columns, iterations, seed, kept=True).select("rep", *metrics.case_ratios(F.col))


def evaluate(rows: DataFrame, kind: str, iterations: int = 200, seed: int = 42, bucket: Column | None = None, names: list[str] | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Rows (metric, estimate, lower, upper) of the kind's endpoints, or of any of its metrics by name.

    Metrics of cases are ratios of sums a group, drawn in place by the law of the table of weights; they need no bucket.
    levels may give their sums, as ``_levels`` makes them."""
    names = ENDPOINTS[kind] if names is None else list(names)
    levels = _levels(rows, kind) if levels is None else levels
    if levels is None:
        drawn, whole = replicates(rows, kind, bootstrap.group_weights(rows, "group_id", iterations, seed, bucket)), metrics_of(rows, kind)
    else:
        drawn, whole = _drawn_cases(levels, iterations, seed), metrics.case_metrics(levels)
    lower, upper = bootstrap.interval(F.col("v"))
    spread = _long(drawn, names, "v").groupBy("metric").agg(lower.alias("lower"), upper.alias("upper"))
    return _long(whole, names, "estimate").join(spread, "metric")


def compare(candidate: DataFrame, reference: DataFrame, kind: str, key: str, truth: list[str], iterations: int = 200, seed: int = 42, bucket: Column | None = None, names: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows (metric, difference, lower, upper, p_value, adjusted): both sides must hold the same samples, groups and truths; with strict, each sample once."""
    names = endpoints_of(kind, names)
    if strict:
        bootstrap.require_pairs(candidate, reference, [key], "group_id", truth)
    else:
        pairing = bootstrap.paired_rows(candidate, reference, [key], "group_id", truth).first()
        if pairing["mismatches"]:
            raise ValueError(f"{pairing['mismatches']} samples differ between the two sides")
    weights = bootstrap.group_weights(candidate, "group_id", iterations, seed, bucket)
    a, b = (replicates(side, kind, weights) for side in (candidate, reference))
    gaps = a.select("rep", *[F.col(n).cast("double") for n in names]).join(b.select("rep", *[F.col(n).cast("double").alias(f"r_{n}") for n in names]), "rep")
    gaps = gaps.select(*[(F.col(n) - F.col(f"r_{n}")).alias(n) for n in names])
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v)
    tail = lambda c: (F.count_if(finite & c) + 1.0) / (F.count_if(finite) + 1.0)
    p = F.when(F.count_if(finite) > 0, F.least(F.lit(1.0), 2 * F.least(tail(v <= 0), tail(v >= 0)))).otherwise(float("nan"))
    lower, upper = bootstrap.interval(v)
    spread = _long(gaps, names, "v").groupBy("metric").agg(lower.alias("lower"), upper.alias("upper"), p.alias("p_value"))
    whole = _long(metrics_of(candidate, kind), names, "a").join(_long(metrics_of(reference, kind), names, "b"), "metric")
    return bootstrap.holm(whole.select("metric", (F.col("a") - F.col("b")).alias("difference")).join(spread, "metric"))


def payload(rows: DataFrame, kind: str, iterations: int = 200, seed: int = 42, reference: DataFrame | None = None, key: str = "case_id", truth: list[str] = (), names: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """One row (payload): the evaluation as JSON, with metrics, intervals, how they were drawn and, with a reference, the comparison.

    NaN stands as the text "NaN"; a metric that isn't the kind's is an error."""
    levels = _levels(rows, kind)
    whole = metrics_of(rows, kind) if levels is None else metrics.case_metrics(levels)
    chosen = endpoints_of(kind, names)
    if unknown := [n for n in chosen if n not in whole.columns]:
        raise ValueError(f"unknown endpoints: {', '.join(unknown)}")
    table = lambda df: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct(*[c for c in df.columns if c != "metric"]))))).alias("m"))  # noqa: E731  # a row a metric
    out = whole.select(F.struct(*whole.columns).alias("metrics")).crossJoin(table(evaluate(rows, kind, iterations, seed, bucket, chosen, levels)).withColumnRenamed("m", "confidence_intervals"))
    out = out.withColumn("bootstrap", F.struct(F.lit(iterations).alias("iterations"), F.lit(seed).alias("seed"), F.lit("group_id").alias("cluster_key")))
    if reference is not None:
        out = out.crossJoin(table(compare(rows, reference, kind, key, list(truth), iterations, seed, bucket, chosen)).withColumnRenamed("m", "comparison"))
    return out.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *out.columns)).alias("payload"))
