"""Prediction rows and metrics. Each metric is a sum over rows, so weights (a resample) change sums only."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import first_argmax, multi_hot, ratio, sentence_class, thresholded
from .components import cut


def static_predictions(records: DataFrame, charges: Sequence[str], articles: Sequence[str], penalties: Sequence[str], threshold: float = 0.5, article_threshold: float | None = None) -> DataFrame:
    """Evaluation rows of records that carry charge_probabilities, article_probabilities, penalty_index and sentence_months."""
    names = lambda vocabulary, hot: F.filter(F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v, i: F.when(F.get(hot, i) == 1, v)), lambda v: v.isNotNull())
    known = lambda vocabulary: F.array(*[F.lit(v) for v in vocabulary])
    out = records.withColumns({"predicted_charges": thresholded("charge_probabilities", threshold), "predicted_articles": thresholded("article_probabilities", threshold if article_threshold is None else article_threshold)})
    there = F.coalesce(F.col("articles_available"), F.lit(True))
    labels = F.when(there, F.coalesce("conviction_articles", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({
        "true_charges": multi_hot("charges", charges), "unseen_true_charge_labels": F.filter("charges", lambda c: ~F.array_contains(known(charges), c)),
        "true_article_labels": labels, "true_articles": F.when(there, multi_hot(labels, articles)), "unseen_true_article_labels": F.filter(labels, lambda c: ~F.array_contains(known(articles), c)),
        "predicted_penalty_type": F.element_at(known(penalties), F.col("penalty_index") + 1),
    })
    return out.select(
        "case_id", "group_id", "articles_available", "true_charges", "predicted_charges", "charge_probabilities", F.col("charges").alias("true_charge_labels"),
        "unseen_true_charge_labels", names(charges, F.col("predicted_charges")).alias("predicted_charge_labels"), "true_articles", "predicted_articles", "article_probabilities",
        "true_article_labels", "unseen_true_article_labels", names(articles, F.col("predicted_articles")).alias("predicted_article_labels"), "penalty_type", "predicted_penalty_type",
        F.col("imprisonment_months").cast("double").alias("true_months"), F.col("sentence_months").cast("double").alias("predicted_months"),
        ((F.col("predicted_charges") == F.col("true_charges")) & (F.size("unseen_true_charge_labels") == 0)).alias("correct"),
        F.when(there, (F.col("predicted_articles") == F.col("true_articles")) & (F.size("unseen_true_article_labels") == 0)).alias("article_correct"),
    )


def counterfactual_predictions(pairs: DataFrame, charges: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Evaluation rows of pairs: labels become places in the vocabulary; labels outside it are left out of the parent's."""
    vocabulary = F.array(*[F.lit(v) for v in charges])
    place = lambda label: (F.array_position(vocabulary, label) - 1).cast("int")
    return pairs.select(
        "case_id", "group_id", "generation_id", "intervention_type", F.lit(None).cast("string").alias("rule_id"), F.when(F.col("target_charge").isNotNull(), place(F.col("target_charge"))).alias("target_charge"),
        F.filter(F.transform("charges", place), lambda i: i >= 0).alias("parent_charge_indices"), F.lit(threshold).alias("charge_threshold"), "rank_direction", "parent_charge_probabilities",
        "counterfactual_charge_probabilities", "parent_sentence", "counterfactual_sentence", "charges", "penalty_type", "imprisonment_months", "restitution",
    )


def label_places(truth: str, prediction: str, unseen: str | None = None) -> Column:
    """Multi-hot arrays as an array of (label, t, p); each unseen true label is a class of its own that nobody predicts."""
    hot = F.transform(F.arrays_zip(F.col(truth).alias("t"), F.col(prediction).alias("p")), lambda x, i: F.struct(F.concat(F.lit("#"), i.cast("string")).alias("label"), x["t"].cast("int").alias("t"), x["p"].cast("int").alias("p")))
    if unseen:
        extra = F.transform(F.coalesce(F.array_distinct(unseen), F.array().cast("array<string>")), lambda u: F.struct(F.concat(F.lit("u:"), u).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")))
        hot = F.concat(hot, extra)
    return hot


def label_counts(rows: DataFrame, truth: str, prediction: str, unseen: str | None = None, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows (*by, label, tp, fp, fn) of multi-hot arrays, as label_places has them."""
    w = F.col(weight) if weight else F.lit(1.0)
    flat = rows.select(*by, w.alias("w"), F.explode(label_places(truth, prediction, unseen)).alias("x")).select(*by, "w", "x.*")
    return flat.groupBy(*by, "label").agg(
        F.sum(F.col("w") * F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("w") * (1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("w") * F.col("t") * (1 - F.col("p"))).alias("fn")
    )


def label_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro and macro precision, recall and F1, macro over supported labels and over all."""
    p, r, f = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn")), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    supported = F.col("tp") + F.col("fn") > 0
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    macro = {f"macro_{n}{suffix}": F.coalesce(F.avg(F.when(cond, v)), F.lit(0.0)) for suffix, cond in (("", supported), ("_all_labels", F.lit(True))) for n, v in (("precision", p), ("recall", r), ("f1", f))}
    micro = {"micro_precision": ratio(tp, tp + fp), "micro_recall": ratio(tp, tp + fn), "micro_f1": ratio(2 * tp, 2 * tp + fp + fn)}
    return counts.groupBy(*by).agg(*[v.alias(k) for k, v in (micro | macro).items()])


def agreement_sums(truth: str, prediction: str, unseen: str | None = None, weight: str | None = None) -> dict[str, Column]:
    """Sums of rows, of those whose label sets are equal, and of the shares of equal places; rows without a truth are left out."""
    w = F.when(F.col(truth).isNotNull(), F.col(weight) if weight else F.lit(1.0))
    extra = F.size(F.coalesce(F.array_distinct(unseen), F.array().cast("array<string>"))) if unseen else F.lit(0)
    same = F.aggregate(F.zip_with(truth, prediction, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    exact = ((same == F.size(truth)) & (extra == 0)).cast("double")
    return {k: F.coalesce(F.sum(v), F.lit(0.0)) for k, v in (("n", w), ("exact", w * exact), ("same", w * same / (F.size(truth) + extra)))}


def row_agreement(rows: DataFrame, truth: str, prediction: str, unseen: str | None = None, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose label sets are equal, and mean share of equal places (unseen labels add wrong places)."""
    sums = agreement_sums(truth, prediction, unseen, weight)
    share = lambda c: ratio(sums[c], sums["n"])
    return rows.groupBy(*by).agg(share("exact").alias("accuracy"), share("same").alias("hamming_accuracy"))


def class_metrics(rows: DataFrame, truth: Column, prediction: Column, labels: Sequence[str] | None = None, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall and F1 of one label a row: over declared labels, or over those that the truth has."""
    w = F.col(weight) if weight else F.lit(1.0)
    pair = rows.select(*by, w.alias("w"), truth.alias("t"), prediction.alias("p"))
    # one row per pair of classes from here on
    cells = pair.groupBy(*by, "t", "p").agg(F.sum("w").alias("w"))
    sides = cells.select(*by, "w", F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("p").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("x"), (F.col("t") == F.col("p")).alias("hit"))
    per = sides.groupBy(*by, "x.label").agg(F.sum(F.when(F.col("hit"), F.col("w") * F.col("x.a")).otherwise(0.0)).alias("tp"), F.sum(F.col("w") * F.col("x.a")).alias("actual"), F.sum(F.col("w") * F.col("x.b")).alias("predicted"))
    p, r, f = ratio("tp", "predicted"), ratio("tp", "actual"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual"))
    if labels is None:
        mean = lambda v: F.coalesce(F.avg(F.when(F.col("actual") > 0, v)), F.lit(0.0))
    else:
        mean = lambda v: F.sum(F.when(F.col("label").isin(list(labels)), v).otherwise(0.0)) / len(labels)
    return per.groupBy(*by).agg(ratio(F.sum("tp"), F.sum("actual")).alias("accuracy"), mean(p).alias("macro_precision"), mean(r).alias("macro_recall"), mean(f).alias("macro_f1"))


def month_sums(predicted: str, truth: str, eligible: Column, tolerance: float = 3.0, weight: str | None = None) -> dict[str, Column]:
    """Sums over eligible rows with two finite values: rows, errors, errors of logarithms, and those within the tolerance."""
    w = F.col(weight) if weight else F.lit(1.0)
    p, t = F.col(predicted).cast("double"), F.col(truth).cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    w = F.when(F.coalesce(eligible, F.lit(False)) & finite(p) & finite(t), w)
    err = F.abs(p - t)
    log_err = F.abs(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(t, F.lit(0.0))))
    return {k: F.coalesce(F.sum(v), F.lit(0.0)) for k, v in (("n", w), ("err", w * err), ("log_err", w * log_err), ("within", w * (err <= tolerance).cast("double")))}


def month_ratios(sums: dict[str, Column]) -> dict[str, Column]:
    """Month metrics of such sums; NaN where nothing is eligible."""
    mean = lambda c: F.coalesce(F.try_divide(sums[c], sums["n"]), F.lit(float("nan")))
    return {"eligible_count": F.round(sums["n"]).cast("long"), "mae": mean("err"), "log_mae": mean("log_err"), "tolerance_accuracy": mean("within")}


def month_metrics(rows: DataFrame, predicted: str, truth: str, eligible: Column, tolerance: float = 3.0, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and log errors and the share within a tolerance, on eligible rows with two finite values; NaN without any."""
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in month_ratios(month_sums(predicted, truth, eligible, tolerance, weight)).items()])


def counterfactual_values(rows: DataFrame, drift: float) -> DataFrame:
    """The rows with what each kind of intervention is judged by."""
    cf, parent = F.col("counterfactual_charge_probabilities"), F.col("parent_charge_probabilities")
    flip, invariant, rank = (F.col("intervention_type") == k for k in ("charge_flip", "invariant", "sentence_rank"))
    target = F.get(cf, F.col("target_charge"))
    source = F.when(F.size("parent_charge_indices") > 0, F.array_max(F.transform("parent_charge_indices", lambda i: F.get(cf, i)))).otherwise(F.when(flip, F.raise_error(F.lit("charge_flip rows need parent_charge_indices"))).cast("double"))
    moved = F.array_max(F.zip_with(parent, cf, lambda a, b: F.abs(a - b)))
    change = F.col("rank_direction") * (F.col("counterfactual_sentence") - F.col("parent_sentence"))
    limit = F.coalesce("charge_threshold", F.lit(0.5))
    num = lambda c: c.cast("double")
    return rows.withColumns({
        "flip_correct": F.when(flip, num((target >= limit) & (source < limit))), "flip_top1": F.when(flip, num(first_argmax(cf) == F.col("target_charge"))), "flip_margin": F.when(flip, target - source),
        "invariant_violation": F.when(invariant, num((first_argmax(parent) != first_argmax(cf)) | (moved > drift))), "invariant_charge_drift": F.when(invariant, moved),
        "invariant_sentence_drift": F.when(invariant, F.abs(F.col("counterfactual_sentence") - F.col("parent_sentence")) / F.greatest(F.col("parent_sentence"), F.lit(1.0))),
        "rank_score": F.when(rank, F.when(change > 0, 1.0).when(change == 0, 0.5).otherwise(0.0)), "rank_tie": F.when(rank, num(change == 0)), "rank_margin": F.when(rank, num(change > 1.0)),
    })


# What each kind of intervention is judged by, and the metric that is its mean.
JUDGED = {
    "flip_correct": "flip_accuracy", "flip_top1": "flip_top1_accuracy", "flip_margin": "flip_margin", "invariant_violation": "invariant_violation_rate", "invariant_charge_drift": "invariant_charge_drift",
    "invariant_sentence_drift": "invariant_sentence_drift", "rank_score": "sentence_pairwise_accuracy", "rank_tie": "sentence_rank_tie_rate", "rank_margin": "sentence_pairwise_accuracy_margin",
}
KINDS = {"charge_flip": "flip_count", "invariant": "invariant_count", "sentence_rank": "sentence_rank_count"}


def counterfactual_sums(rows: DataFrame, drift: float, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows (*by, s_<value>, n_<value>, <kind>_count): sums of what pairs are judged by."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = [F.sum(F.when(F.col("intervention_type") == k, w).otherwise(0.0)).alias(name) for k, name in KINDS.items()]
    for c in JUDGED:
        out += [F.coalesce(F.sum(w * F.col(c)), F.lit(0.0)).alias(f"s_{c}"), F.coalesce(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0.0)).alias(f"n_{c}")]
    return counterfactual_values(rows, drift).groupBy(*by).agg(*out)


def counterfactual_ratios(sums: DataFrame, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of pairs from sums, each counted weight times; NaN for a kind without rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(w * F.col(f"s_{c}")), F.sum(w * F.col(f"n_{c}"))), F.lit(float("nan")))
    counts = [F.round(F.coalesce(F.sum(w * F.col(n)), F.lit(0.0))).cast("long").alias(n) for n in KINDS.values()]
    return sums.groupBy(*by).agg(*counts, *[mean(c).alias(n) for c, n in JUDGED.items()], (1.0 - mean("rank_score")).alias("monotonicity_violation_rate"))


def counterfactual_metrics(rows: DataFrame, drift: float, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    return counterfactual_ratios(counterfactual_sums(rows, drift, weight, by), None, by)


def case_levels(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Per group: defendants, correct ones and whether all are, at the levels charge, charge and article, and full."""
    c = F.col("correct")
    ca = c & F.coalesce("article_correct", F.lit(False))
    full = ca & (sentence_class("penalty_type", "true_months") == sentence_class(F.coalesce("predicted_penalty_type", "penalty_type"), "predicted_months"))
    out = [F.count("*").alias("defendants")]
    for name, level in (("charge", c), ("charge_article", ca), ("full", full)):
        out += [F.sum(level.cast("long")).alias(f"{name}_right"), F.min(level.cast("int")).alias(f"{name}_case")]
    return rows.groupBy(group).agg(*out)


def case_metrics(levels: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Defendant and case accuracy over groups' levels."""
    w = F.col(weight) if weight else F.lit(1.0)
    return levels.groupBy(*by).agg(*case_ratios(lambda c: F.sum(w if c == "cases" else w * F.col(c))))


def case_ratios(total: Callable[[str], Column]) -> list[Column]:
    """The columns of ``case_metrics`` from the sums of the levels' columns, and of ``cases``, the groups."""
    out = [F.round(total("defendants")).cast("long").alias("defendant_count"), F.round(total("cases")).cast("long").alias("case_count")]
    for n in ("charge", "charge_article", "full"):
        out += [ratio(total(f"{n}_right"), total("defendants")).alias(f"defendant_{n}_accuracy"), ratio(total(f"{n}_case"), total("cases")).alias(f"case_{n}_accuracy")]
    return out


def threshold_counts(rows: DataFrame, probabilities: str, truth: str, grid: Sequence[float]) -> DataFrame:
    """Rows (threshold, tp, n): true positives, and predicted plus true labels, as ``thresholded`` predicts at each threshold.

    One pass, whatever the number of thresholds: scores are counted by the number of thresholds that they reach, so what
    a threshold lets through is a sum over higher bins. Rows whose best score reaches fewer thresholds predict that score's
    first place at the others: those are counted by the best score's bin and summed from below. Tasks return a histogram
    each, which is all that is shuffled. Rows with a null array take no part; null scores reach nothing, null truths are 0."""
    grid = sorted({float(g) for g in grid})
    edges, names = np.array(grid), ["bin", "items", "positives", "rows", "first_positives", "truths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(grid) + 1, 5), np.int64)
        for b in batches:
            p, t = b.column(0), b.column(1)
            score = p.flatten().fill_null(-np.inf).to_numpy(zero_copy_only=False)
            true = t.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            size, other = np.diff(p.offsets.to_numpy()), np.diff(t.offsets.to_numpy())
            held[0, 4] += true.sum()
            at = np.arange(len(score)) - np.repeat(np.cumsum(size) - size, size)  # place in the row
            places = np.repeat(np.cumsum(other) - other, size) + at
            own = np.where(at < np.repeat(other, size), true[np.minimum(places, len(true) - 1)], 0) if len(true) else np.zeros(len(score), np.int64)
            bins = np.searchsorted(edges, score, "right")
            held[:, 0] += np.bincount(bins, minlength=len(held))
            held[:, 1] += np.bincount(bins, own, len(held)).astype(np.int64)
            some = size > 0
            if some.any():
                best = np.maximum.reduceat(score, (np.cumsum(size) - size)[some])
                row = np.repeat(np.arange(some.sum()), size[some])
                tops = np.flatnonzero(score == best[row])
                first = tops[np.unique(row[tops], return_index=True)[1]]
                held[:, 2] += np.bincount(bins[first], minlength=len(held))
                held[:, 3] += np.bincount(bins[first], own[first], len(held)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), *[pa.array(c) for c in held.T]], names=names)

    both = rows.where(F.col(probabilities).isNotNull() & F.col(truth).isNotNull()).select(F.col(probabilities).cast("array<double>").alias("p"), F.col(truth).cast("array<long>").alias("t"))
    met = both.mapInArrow(run, ", ".join(f"`{n}` long" for n in names)).groupBy("bin").agg(*[F.sum(n).alias(n) for n in names[1:]])
    up, down = Window.orderBy(F.desc("bin")), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a threshold
    over = lambda n: F.sum(n).over(up.rowsBetween(Window.unboundedPreceding, 0))
    under = lambda n: F.sum(n).over(down)
    sums = met.select("bin", (over("positives") + under("first_positives")).alias("tp"), (over("items") + under("rows") + F.sum("truths").over(Window.partitionBy())).alias("n"))
    return sums.where("bin > 0").select(F.element_at(F.array(*[F.lit(g) for g in grid]), F.col("bin").cast("int")).alias("threshold"), "tp", "n")


def tune_threshold(rows: DataFrame, probabilities: str, truth: str, grid: Sequence[float] = tuple(round(0.05 * k, 2) for k in range(1, 20))) -> DataFrame:
    """One row (threshold, micro_f1): the lowest threshold with the best micro F1."""
    best = threshold_counts(rows, probabilities, truth, grid).select("threshold", ratio(2 * F.col("tp"), "n").alias("micro_f1"))
    return best.orderBy(F.desc("micro_f1"), "threshold").limit(1)


def majority_and_mean(rows: DataFrame, labels: str, months: str, order: str) -> DataFrame:
    """One row (label, n, mean_months): the most frequent label, the first seen among equals, and the mean of months."""
    flat = rows.select(F.posexplode(labels).alias("pos", "label"), order)
    counts = flat.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct(order, "pos")).alias("first"))
    top = counts.orderBy(F.desc("n"), "first").limit(1).select("label", "n")
    return top.crossJoin(rows.agg(F.avg(months).alias("mean_months")))  # one row by one row


def best_row(rows: DataFrame, name: str, score: str, steps: str) -> DataFrame:
    return rows.agg(F.max_by(name, F.struct(score, steps)).alias(name))


def stable_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of their key: the same ones however the table is laid out."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


class Reservoir:
    """n of the rows seen so far, each set of n as likely as any: row t, from 1, takes a random place with probability n / t."""

    def __init__(self, n: int, rng: np.random.Generator) -> None:
        self.n, self.rng, self.seen, self.held = n, rng, 0, None

    def add(self, batch: pa.RecordBatch) -> None:
        table = pa.Table.from_batches([batch])
        at = self.seen + np.arange(len(table))
        places = np.where(at < self.n, at, self.rng.integers(0, at + 1))
        self.seen += len(table)
        taken = np.flatnonzero(places < self.n)
        if not len(taken):
            return
        old = 0 if self.held is None else len(self.held)
        index = np.concatenate([np.arange(old), np.full(min(self.n, self.seen) - old, -1)])
        index[places[taken]] = old + np.arange(len(taken))  # of two rows for a place the later one stays
        both = table.take(pa.array(taken)) if self.held is None else pa.concat_tables([self.held, table.take(pa.array(taken))])
        self.held = both.take(pa.array(index)).combine_chunks()

    def shuffled(self) -> pa.Table | None:
        return None if self.held is None else self.held.take(pa.array(self.rng.permutation(len(self.held))))


def shares(seen: Sequence[int], n: int, seed: int) -> list[int]:
    """How many of n rows drawn without replacement come from each of the tasks that have seen so many: multivariate hypergeometric."""
    total = sum(seen)
    drawn = random.Random(seed).sample(range(total), min(n, total))
    ends = np.cumsum(np.array(seen, np.int64))
    return np.bincount(np.searchsorted(ends, drawn, "right"), minlength=len(seen)).tolist()


def reservoir_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows (all, where there are fewer), every set of n as likely, in one pass and without a sort.

    A task keeps a reservoir of n rows; the driver gets a count a task and deals the n among them by hypergeometric
    shares, and so many rows of each reservoir, which is in random order, are the sample. Rows are told apart by place,
    so equal rows and nulls count like others. The draw depends on the table's layout; ``stable_sample`` doesn't.
    n rows a task are held and written once to the checkpoint folder, so n bounds memory."""
    if n < 1:
        return rows.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        kept = Reservoir(n, np.random.default_rng([seed, task]))
        for b in batches:
            if b.num_rows:
                kept.add(b)
        out = kept.shuffled()
        if out is not None:
            size = len(out)
            out = out.append_column("task", pa.array([task] * size, pa.int64())).append_column("seen", pa.array([kept.seen] * size, pa.int64())).append_column("place", pa.array(range(size), pa.int64()))
            yield from out.to_batches(max_chunksize=1024)

    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    schema = T.StructType([*whole.schema.fields, *[T.StructField(c, T.LongType()) for c in ("task", "seen", "place")]])
    held = cut(whole.mapInArrow(run, schema))
    counts = sorted((r.task, r.seen) for r in held.where("place = 0").select("task", "seen").collect())  # a row a task
    dealt = [(t, k) for (t, _), k in zip(counts, shares([c for _, c in counts], n, seed)) if k]
    if not dealt:
        return rows.limit(0)
    share = F.broadcast(rows.sparkSession.createDataFrame(dealt, "task long, share long"))  # n rows at most
    return held.join(share, "task").where("place < share").select("row.*")


def first_group_index(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Distinct groups with the place of their first row."""
    return rows.groupBy(group).agg(F.min(order).alias("first"))


def weighted_mean(v: Column, w: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(v * w), F.sum(w)), F.lit(float("nan")))


def running_first(rows: DataFrame, part: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(part).orderBy(order)))
