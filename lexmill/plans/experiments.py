"""The named experiments as settings, and the rows that each of them trains on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import presets
from ..operators import interventions, splits, store


def experiment(name: str, table: dict[str, dict] = presets.EXPERIMENTS, base: dict = presets.EXPERIMENT_BASE) -> dict:
    """All settings of an experiment, those of the one it starts from first."""
    if name not in table:
        raise ValueError(f"unknown experiment {name!r}")
    own = dict(table[name])
    start = experiment(own.pop("from"), table, base) if "from" in own else dict(base)
    return {**start, **own, "name": name}


def kinds(settings: dict) -> list[str]:
    """The kinds of edits whose loss is on."""
    switches = {"use_invariant": "invariant", "use_boundary": "charge_flip", "use_rank": "sentence_rank"}
    return [kind for switch, kind in switches.items() if settings[switch]]


def training_rows(records: DataFrame, pairs: DataFrame, settings: dict, vocabulary: list[str], limit: int | None = None, order: str = "generation_id") -> tuple[DataFrame, DataFrame | None]:
    """The records to train on and the pairs beside them.

    Ordinary augmentation adds edited texts as records; typed edits stay pairs of the kinds that are on. Both take valid
    pairs without leakage unless the filter is off, flips to charges that training knows, and the first ``limit`` of what is left."""
    if not settings["ordinary_augmentation"] and not settings["typed_counterfactuals"]:
        return records, None
    usable = store.clean_records(pairs) if settings["filter_counterfactuals"] else pairs
    usable = interventions.known_targets(usable, vocabulary)
    if settings["typed_counterfactuals"]:
        usable = interventions.allowed(usable, kinds(settings))
    usable = usable if limit is None else splits.first_rows(usable, [order], limit)
    if settings["ordinary_augmentation"]:
        return records.unionByName(interventions.augmentation(usable).select(*[c for c in records.columns if c in usable.columns]), allowMissingColumns=True), None
    return records, usable
