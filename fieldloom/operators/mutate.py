"""Appending rows, replacing them by id, and comparing studies."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.joins import map_categories
from fieldloom.operators.ordering import running_sum
from fieldloom.sources.manifest import TABLE_ROLES
from fieldloom.sources.study import Study, StudyError


def compare_structure(own: Study, other: Study) -> list[str]:
    """How the declarations differ, bounds and row counts aside."""
    def facts(m):
        free = ("lower", "upper")
        out = {f"keys/{k.name}": {a: v for a, v in dataclasses.asdict(k).items() if a not in free} for k in m.keys}
        out |= {s.path: dataclasses.asdict(s) for s in m.slots}
        out |= {f"supports/{s.name}": dataclasses.asdict(s) for s in m.supports}
        out |= {f"callables/{c.id}": dataclasses.asdict(c) for c in m.models}
        return out

    a, b = facts(own.manifest), facts(other.manifest)
    out = [f"{p}: only in one" for p in sorted(set(a) ^ set(b))]
    for p in sorted(set(a) & set(b)):
        out += [f"{p}: {k} {a[p][k]!r} <> {b[p].get(k)!r}" for k in a[p] if a[p][k] != b[p].get(k)]
    return out


def remap_ids(own: Study, batch: Study) -> Study:
    """The batch with its category ids put in the study's, by entry; unknown entries are refused."""
    rows = batch.rows
    for key in batch.manifest.keys:
        if key.role not in TABLE_ROLES:
            continue
        ids = map_categories(own.entries(own.manifest.key(key.name).category), batch.entries(key.category)).select("from_id", "to_id", "entry")
        joined = rows.join(ids, F.col(key.name) == F.col("from_id"), "left")
        known = F.when(F.col("to_id").isNull(), F.raise_error(F.concat(F.lit(f"E10: {key.name} has an unknown entry "), F.coalesce("entry", F.lit("?")))).cast("int")).otherwise(F.col("to_id"))
        rows = joined.withColumn(key.name, known).drop("from_id", "to_id", "entry")
    return batch.replace(rows=rows)


def append_rows(own: Study, batch: Study, replace_by: str | None = None) -> Study:
    """The study with the batch's rows; those with a known id take its row's place.

    Both must be declared alike and be aligned.  Bounds widen, the batch's notes
    replace those of the same name, writer and creation time stay.
    """
    if not (own.manifest.aligned and batch.manifest.aligned):
        raise StudyError("E37", "only aligned studies can be appended to")
    differ = compare_structure(own, batch)
    if differ:
        raise StudyError("E16", f"the batch is declared otherwise: {differ[0]}")
    batch = remap_ids(own, batch)
    n = own.manifest.n_rows
    if replace_by is None:
        place = batch.rows.select(F.col("row").alias("__old"), (F.col("row") + n).alias("__new"))
        added = batch.manifest.n_rows
    else:
        if own.manifest.key(replace_by).role != "id":
            raise StudyError("E03", f"{replace_by} is not an id key")
        twice = batch.rows.groupBy(replace_by).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise StudyError("E16", f"the batch holds {replace_by} {twice[0][0]!r} twice")
        known = own.rows.select(F.col(replace_by).alias("__id"), F.col("row").alias("__at"))
        met = batch.rows.select("row", replace_by).join(known, F.col(replace_by) == F.col("__id"), "left")
        counted = running_sum(met, ["row"], F.col("__at").isNull().cast("int"), "__nth")
        place = counted.select(F.col("row").alias("__old"), F.coalesce("__at", F.col("__nth") - 1 + n).cast("bigint").alias("__new"))
        added = place.where(F.col("__new") >= n).count()
    moved = batch.rows.join(place, F.col("row") == F.col("__old")).withColumn("row", F.col("__new")).drop("__old", "__new")
    gone = place.where(F.col("__new") < n).select("__new")
    rows = own.rows.join(gone, F.col("row") == F.col("__new"), "left_anti").unionByName(moved)
    varying = [s.path for s in own.manifest.arrays() if s.varies == "row"]
    payload = own.slot_values
    if varying:
        by_row = F.concat_ws("/", "support", F.concat("location", F.lit("_arrays")), "slot").isin(varying)
        old = payload.where(by_row).join(gone, F.col("instance") == F.col("__new"), "left_anti")
        new = batch.slot_values.where(by_row).join(place, F.col("instance") == F.col("__old")).withColumn("instance", F.col("__new")).drop("__old", "__new")
        payload = payload.where(~by_row).unionByName(old).unionByName(new)
    keys = []
    for k in own.manifest.keys:
        b = batch.manifest.key(k.name)
        low = [x for x in (k.lower, b.lower) if x is not None]
        high = [x for x in (k.upper, b.upper) if x is not None]
        keys.append(dataclasses.replace(k, lower=min(low) if low else None, upper=max(high) if high else None))
    manifest = dataclasses.replace(own.manifest, n_rows=n + added, keys=keys, notes=own.manifest.notes | batch.manifest.notes)
    return own.replace(manifest=manifest, rows=rows, slot_values=payload)


def table_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, n): rows only in one table, and rows whose other columns differ.

    NaN equals NaN, and null equals null.
    """
    columns = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*columns).alias("__a")) if columns else left.select(*keys, F.lit(1).alias("__a"))
    b = right.select(*keys, F.struct(*columns).alias("__b")) if columns else right.select(*keys, F.lit(1).alias("__b"))
    same = None
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = c if same is None else same & c
    met = a.alias("a").join(b.alias("b"), same, "full_outer")
    kind = F.when(F.col("__a").isNull(), "only right").when(F.col("__b").isNull(), "only left").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return met.select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


def structural_difference(left: Study, right: Study) -> DataFrame:
    """(path, kind, n): every way two studies differ; empty if they are equal."""
    spark = left.spark
    declared = [(d.split(":")[0], d.split(": ", 1)[1], 1) for d in compare_structure(left, right)]
    out = spark.createDataFrame(declared, "path string, kind string, n bigint")
    common = [c for c in left.rows.columns if c in right.rows.columns]
    tables = {"rows": (left.rows.select(common), right.rows.select(common), ["row"]), "slot_values": (left.slot_values, right.slot_values, ["support", "location", "slot", "instance", "draw"]), "cells": (left.cells, right.cells, ["support", "cell"]), "categories": (left.categories, right.categories, ["table_name", "id"])}
    for path, (a, b, keys) in tables.items():
        out = out.unionByName(table_difference(a, b, keys).select(F.lit(path).alias("path"), "kind", "n"))
    return out


def structurally_equal(left: Study, right: Study) -> bool:
    return structural_difference(left, right).limit(1).count() == 0


def derived_difference(payload: DataFrame, reference_instance: int) -> DataFrame:
    """(instance, values): each instance minus the reference instance, element by element."""
    base = payload.where(F.col("instance") == reference_instance).select(F.col("values").alias("__base"))
    return payload.join(F.broadcast(base.limit(1))).select("instance", F.zip_with("values", "__base", lambda x, y: x - y).alias("values"))
