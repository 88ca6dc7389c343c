"""Weighted sums of a field over its sites."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.units import product
from fieldloom.operators.geometry import computed_weights
from fieldloom.operators.joins import gather
from fieldloom.operators.statistics import _sites
from fieldloom.sources.manifest import Slot
from fieldloom.sources.study import Study


def stored_weight(study: Study, slot: Slot) -> Slot | None:
    """The weight at the slot's place, if one is stored."""
    found = [s for s in study.manifest.arrays() if s.role == "weight" and (s.support, s.location) == (slot.support, slot.location)]
    return found[0] if found else None


def integrated_units(slot: Slot, weight: Slot) -> str:
    return product(slot.units or "1", weight.units or "1")


def site_weights(study: Study, slot: Slot) -> tuple[DataFrame, str]:
    """(instance, site, weight) and what the instances vary along."""
    weight = stored_weight(study, slot)
    if weight is not None:
        return study.long(weight).select("instance", "site", F.col("value").alias("weight")), weight.varies
    warnings.warn(f"no weight stored for {slot.path}: computed from the cells", stacklevel=2)
    coords = next(s for s in study.manifest.arrays() if s.support == slot.support and s.role == "coordinates")
    return computed_weights(study, slot.support, slot.location), coords.varies


def integrate(study: Study, slot: Slot, by: str | None = None, region: str | None = None) -> DataFrame:
    """(row, component, integral, n_missing): NaN is skipped and counted.

    With ``by`` and ``region`` only the sites whose label is that region count.
    """
    weights, varies = site_weights(study, slot)
    width = slot.components or 1
    field = gather(study, slot)
    long = field.select("row", F.posexplode("values").alias("at", "value")).select("row", F.expr(f"CAST(at DIV {width} AS BIGINT)").alias("site"), (F.col("at") % width).cast("int").alias("component"), "value")
    if by is not None:
        chosen = _sites(study, slot, by).where(F.col(by) == region).select(F.col("site").alias("__chosen"))
        long = long.join(chosen, F.col("site") == F.col("__chosen"), "left_semi")
    if varies == "none":
        long = long.join(weights.select(F.col("site").alias("__site"), "weight"), F.col("site") == F.col("__site"))
    else:
        import dataclasses

        from fieldloom.operators.joins import rows_with_instance

        place = rows_with_instance(study, dataclasses.replace(slot, varies=varies)).select(F.col("row").alias("__row"), F.col("instance").alias("__of"))
        long = long.join(place, F.col("row") == F.col("__row")).join(weights.select(F.col("site").alias("__site"), "instance", "weight"), (F.col("site") == F.col("__site")) & (F.col("instance") == F.col("__of")))
    good = F.when(~F.isnan("value"), F.col("value") * F.col("weight"))
    return long.groupBy("row", "component").agg(F.coalesce(F.sum(good), F.lit(0.0)).alias("integral"), F.count_if(F.isnan("value")).alias("n_missing"))
