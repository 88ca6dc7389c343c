"""Joins of rows with what they share: categories, supports, instances.

Small sides are left to Spark: it broadcasts what it knows to be small, and
shuffles the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.names import varies_group
from fieldloom.operators.ordering import numbered
from fieldloom.sources.manifest import CONVERGED, Slot
from fieldloom.sources.staging import stored
from fieldloom.sources.study import Study, StudyError


def category_table(frame: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a string column in byte order, numbered from 0.

    It is stored, so that Spark sees its true size: a short one is broadcast, and
    rows aren't dealt to a task for each of a few values.
    """
    values = frame.where(F.col(column).isNotNull()).select(F.col(column).alias("entry")).distinct()
    number = F.row_number().over(Window.orderBy("entry")) - 1
    return stored(values.select(F.lit(name).alias("table_name"), number.cast("int").alias("id"), "entry"))


def encode_category(frame: DataFrame, column: str, table: DataFrame, to: str) -> DataFrame:
    """Entries to ids; an entry that the table doesn't have is refused when it is read."""
    side = table.select(F.col("entry").alias("__entry"), F.col("id").alias("__id"))
    joined = frame.join(side, F.col(column) == F.col("__entry"), "left")
    known = F.when(F.col(column).isNotNull() & F.col("__id").isNull(), F.raise_error(F.concat(F.lit("E10: unknown entry "), F.col(column))).cast("int")).otherwise(F.col("__id"))
    return joined.withColumn(to, known).drop(*([] if to == "__id" else ["__id"]), "__entry")


def decode_category(frame: DataFrame, column: str, entries: DataFrame, to: str) -> DataFrame:
    """Ids to entries; an id without one falls back to its digits."""
    side = entries.select(F.col("id").alias("__id"), F.col("entry").alias("__entry"))
    joined = frame.join(side, F.col(column) == F.col("__id"), "left")
    return joined.withColumn(to, F.coalesce("__entry", F.col(column).cast("string"))).drop("__id", "__entry")


def unknown_categories(frame: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """Rows whose id has no entry."""
    return frame.join(entries.select(F.col("id").alias("__id")), F.col(column) == F.col("__id"), "left_anti")


def unused_categories(frame: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """Entries that no row uses."""
    return entries.join(frame.select(F.col(column).alias("__used")).distinct(), F.col("id") == F.col("__used"), "left_anti")


def support_of_rows(study: Study) -> DataFrame:
    """(row, support) of every row."""
    names = study.manifest.support_order()
    if not names:
        return study.rows.select("row", F.lit(None).cast("string").alias("support"))
    if study.manifest.aligned:
        return study.rows.select("row", F.lit(names[0]).alias("support"))
    return study.rows.select("row", F.element_at(F.array(*map(F.lit, names)), F.col("support_ix") + 1).alias("support"))


def rows_on(study: Study, support: str) -> DataFrame:
    """The rows on a support, with their place among those rows in file order."""
    if study.manifest.aligned:
        return study.rows.withColumn("ordinal", F.col("row"))
    ix = study.manifest.support_order().index(support)
    here = study.rows.where(F.col("support_ix") == ix)
    return numbered(here, ["row"], "ordinal")


def rows_with_instance(study: Study, slot: Slot) -> DataFrame:
    """Rows with ``instance``, the leading index of ``slot`` that each row reads."""
    group = varies_group(slot.varies)
    base = rows_on(study, slot.support)
    if slot.varies == "none":
        return base.withColumn("instance", F.lit(0).cast("bigint"))
    if slot.varies == "row":
        return base.withColumn("instance", F.col("ordinal").cast("bigint"))
    if group not in {k.name for k in study.manifest.keys}:
        raise StudyError("E04", f"{slot.path} varies along {group}, which is no key")
    return base.withColumn("instance", F.col(group).cast("bigint"))


def gather(study: Study, slot: Slot, columns: list[str] | None = None) -> DataFrame:
    """Each row with the payload of the instance it reads."""
    rows = rows_with_instance(study, slot).select("row", "instance", *(columns or []))
    return rows.join(study.payload(slot).withColumnRenamed("instance", "__instance"), F.col("instance") == F.col("__instance")).drop("__instance")


def parents(study: Study, group: str) -> DataFrame:
    """(group, parent) pairs of a nested group key."""
    parent = study.manifest.key(group).parent
    if parent is None:
        raise StudyError("E04", f"{group} has no parent")
    return study.rows.select(group, parent).distinct()


def map_categories(own: DataFrame, other: DataFrame) -> DataFrame:
    """(from_id, to_id): the ids of ``other`` in ``own``, by entry; null where it has none."""
    a = other.select(F.col("id").alias("from_id"), "entry")
    b = own.select(F.col("id").alias("to_id"), F.col("entry").alias("__entry"))
    return a.join(b, F.col("entry") == F.col("__entry"), "left").select("from_id", "to_id", "entry")


def shared_supports(left: Study, right: Study) -> list[tuple[str, str]]:
    """Pairs of supports of two studies with one digest."""
    return [(a.name, b.name) for a in left.manifest.supports for b in right.manifest.supports if a.support_id and a.support_id == b.support_id]


def bounds_intersection(bounds: DataFrame) -> DataFrame:
    """``bounds``: model, key, lower, upper.  Where all models hold: key, lower, upper, empty."""
    met = bounds.groupBy("key").agg(F.max("lower").alias("lower"), F.min("upper").alias("upper"))
    return met.withColumn("empty", F.col("lower") > F.col("upper"))


def converged(study: Study) -> DataFrame:
    """Rows fit for modelling: all, or those whose status is converged."""
    status = study.manifest.keys_of("status")
    if not status:
        return study.rows
    decoded = decode_category(study.rows, status[0].name, study.entries(status[0].category), "__status")
    return decoded.where(F.col("__status") == CONVERGED).drop("__status")


def outside_bounds(value: Column, lower: float | None, upper: float | None) -> Column:
    """A finite value beyond a bound; a missing one never is."""
    from fieldloom.functions.numbers import finite

    out = F.lit(False)
    if lower is not None:
        out = out | (value < lower)
    if upper is not None:
        out = out | (value > upper)
    return finite(value) & out
