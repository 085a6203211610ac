"""Loss terms as column arithmetic over logits, targets and masks, for monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import softplus


def bce(logits: Column | str, targets: Column | str, mean: bool = False) -> Column:
    """Binary cross entropy of an array of logits, summed over its places or averaged."""
    terms = F.zip_with(logits, targets, lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return total / F.size(terms) if mean else total


def cross_entropy(logits: Column | str, target: Column | str) -> Column:
    """-log softmax at a place; the largest logit is taken out first."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.log(total) + top - F.get(logits, F.col(target) if isinstance(target, str) else target)


def smooth_l1(a: Column | str, b: Column | str) -> Column:
    d = F.abs((F.col(a) if isinstance(a, str) else a) - (F.col(b) if isinstance(b, str) else b))
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def hinge(margin: float, direction: Column, change: Column) -> Column:
    return F.greatest(F.lit(0.0), margin - direction * change)


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean over rows whose mask holds; 0 without any."""
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(0.0))


def invariant_shift(parent: Column | str, child: Column | str) -> Column:
    """Squared change of probabilities, summed."""
    return F.aggregate(F.zip_with(parent, child, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def mixture(logits: Column | str, values: Column | str) -> Column:
    """Softplus values averaged under sigmoid weights that are scaled to one."""
    weights = F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.zip_with(weights, values, lambda w, v: w * softplus(v)), F.lit(0.0), lambda s, x: s + x) / F.greatest(total, F.lit(1e-12))


def mean_pool(vectors: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Element-wise mean of each key's vectors whose mask holds; one row per key and place is shuffled at most."""
    flat = vectors.where(F.col(mask)).select(key, F.posexplode(vector).alias("i", "v"))
    means = flat.groupBy(key, "i").agg(F.avg("v").alias("v"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(vector))


# The terms of a total loss in their order; the first always counts once.
TERMS = ["charge", "article", "sentence", "invariant", "boundary", "response", "factor"]


def typed_losses(rows: DataFrame, terms: dict[str, list[tuple[Column, Column]]], weights: dict[str, float] | None = None) -> DataFrame:
    """One row: each term of TERMS, its rows n_<term>, and the weighted total.

    A term is a list of (value, mask), each averaged over the rows of its mask and added up; without rows it is exactly 0.
    The charge term's weight is 1 whatever the weights say, and a term that isn't named weighs 1."""
    means, counts = [], []
    for t in TERMS:
        parts = terms.get(t, [])
        means.append(sum((masked_mean(v, m) for v, m in parts), F.lit(0.0)).alias(t))
        used = F.lit(False)
        for _, m in parts:
            used = used | F.coalesce(m, F.lit(False))
        counts.append(F.count_if(used).alias(f"n_{t}"))
    scale = {t: float((weights or {}).get(t, 1.0)) for t in TERMS} | {TERMS[0]: 1.0}
    return rows.agg(*means, *counts).withColumn("total", sum((scale[t] * F.col(t) for t in TERMS), F.lit(0.0)))


def loss_problems(losses: DataFrame) -> DataFrame:
    """The rows of typed_losses with ``problems``: terms that aren't finite, and those that have a value without rows."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    codes = [F.when(odd(F.col(t)), t) for t in [*TERMS, "total"]]
    codes += [F.when((F.col(f"n_{t}") == 0) & (F.col(t) != 0), f"{t}:nonzero_without_samples") for t in TERMS]
    return losses.withColumn("problems", F.array_compact(F.array(*codes)))


def guard(losses: DataFrame, step: int, path: str | None = None) -> None:
    """An error if a loss is unsound; with a path, the row is written there as JSON first."""
    bad = loss_problems(losses).where(F.size("problems") > 0).withColumn("step", F.lit(step))
    found = bad.first()
    if found is None:
        return
    if path is not None:
        bad.coalesce(1).write.mode("overwrite").json(path)
    raise ArithmeticError(f"unsound loss at step {step}: {', '.join(found['problems'])}")
