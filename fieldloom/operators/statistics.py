"""Grouped statistics in which a missing value is skipped.

The mean of nothing is NaN and its count 0; std is the population's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.names import text_g6
from fieldloom.functions.numbers import describe, finite, or_nan
from fieldloom.operators.joins import decode_category, gather
from fieldloom.operators.ordering import in_ranges, numbered
from fieldloom.sources.manifest import UNIT_ROLES, Slot
from fieldloom.sources.study import Study, StudyError

RESULTS = ("count", "n_missing", "min", "max", "mean", "std")
#: Bounds wider than this many times the observed width are stale.
STALE_RATIO = 4.0


def scalar_statistics(study: Study, name: str, by: str | None = None) -> DataFrame:
    """Statistics of a scalar or key over the rows, for each entry of the key ``by``."""
    if by is None:
        return study.rows.agg(*describe(F.col(name)))
    stats = study.rows.groupBy(by).agg(*describe(F.col(name)))
    key = study.manifest.key(by)
    if key.category is None:
        return stats.select(F.col(by).alias(by), *RESULTS)
    # the ids are decoded after the aggregation, on one row for each
    return decode_category(stats.withColumnRenamed(by, "__by"), "__by", study.entries(key.category), by).select(by, *RESULTS)


def _sites(study: Study, slot: Slot, by: str) -> DataFrame:
    """(site, group) of a label that doesn't vary, named by its entries."""
    label = study.manifest.find(by, slot.support)
    if label.role != "label" or label.location != slot.location:
        raise StudyError("E02", f"{by} is not a label at the place of {slot.path}")
    long = study.long(label)
    if label.varies != "none":
        raise StudyError("E04", f"{by} varies; group by a label that doesn't")
    groups = long.select("site", F.col("value").cast("int").alias("__label"))
    if label.category is None:
        return groups.select("site", F.col("__label").cast("string").alias(by))
    return decode_category(groups, "__label", study.entries(label.category), by).select("site", by)


def field_statistics(study: Study, slot: Slot, by: str | None = None, per: str = "row") -> DataFrame:
    """Statistics over a slot's sites, for each row and component (and label group).

    ``per="instance"`` gives a line for each stored instance instead of each row.
    Without ``by`` the payload is aggregated inside its record when it has one
    component; nothing is exploded or shuffled then.
    """
    if slot.statistic == "draw":
        raise StudyError("E12", f"{slot.path} holds draws; summarise them first")
    source = gather(study, slot) if per == "row" else study.payload(slot).withColumn("row", F.col("instance"))
    if by is None and slot.components == 1:
        return _inline_statistics(source)
    width = slot.components or 1
    long = source.select("row", F.posexplode("values").alias("at", "value")).select("row", F.expr(f"CAST(at DIV {width} AS BIGINT)").alias("site"), (F.col("at") % width).cast("int").alias("component"), "value")
    keys = ["row", "component"]
    if by is not None:
        long = long.join(_sites(study, slot, by).withColumnRenamed("site", "__site"), F.col("site") == F.col("__site"))
        keys = ["row", by, "component"]
    return long.groupBy(*keys).agg(*describe(F.col("value")))


def _inline_statistics(source: DataFrame) -> DataFrame:
    good = F.filter("values", finite)
    n = F.size("__good").cast("double")
    mean = F.aggregate("__good", F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate("__good", F.lit(0.0), lambda s, x: s + (x - F.col("__mean")) * (x - F.col("__mean")))
    inner = source.select("row", F.size("values").alias("__all"), good.alias("__good")).withColumn("__mean", F.when(F.size("__good") > 0, mean))
    return inner.select(
        "row",
        F.lit(0).alias("component"),
        F.size("__good").cast("bigint").alias("count"),
        (F.col("__all") - F.size("__good")).cast("bigint").alias("n_missing"),
        or_nan(F.array_min("__good")).alias("min"),
        or_nan(F.array_max("__good")).alias("max"),
        or_nan(F.col("__mean")).alias("mean"),
        or_nan(F.when(F.size("__good") > 0, F.sqrt(square / n))).alias("std"),
    )


def pooled_statistics(study: Study, slot: Slot, by: str | None = None) -> DataFrame:
    """One line (for each label group) over all instances, sites and components."""
    long = study.long(slot)
    if by is None:
        return long.agg(*describe(F.col("value")))
    return long.join(_sites(study, slot, by).withColumnRenamed("site", "__site"), F.col("site") == F.col("__site")).groupBy(by).agg(*describe(F.col("value")))


def draw_summaries(study: Study, slot: Slot, quantile: float | None = None) -> DataFrame:
    """mean, std (and an exact, linearly interpolated quantile) over the draws."""
    if slot.statistic != "draw":
        raise StudyError("E12", f"{slot.path} holds no draws")
    good = F.when(finite(F.col("value")), F.col("value"))
    columns = [or_nan(F.avg(good)).alias("mean"), or_nan(F.stddev_pop(good)).alias("std")]
    if quantile is not None:
        columns.append(or_nan(F.percentile(good, F.lit(quantile))).alias("quantile"))
    return study.long(slot).groupBy("instance", "site", "component").agg(*columns)


def observed_bounds(study: Study) -> DataFrame:
    """(key, lower, upper) of the finite values of design, condition and time keys, in one pass."""
    keys = [k.name for k in study.manifest.key_order() if k.role in UNIT_ROLES]
    if not keys:
        return study.spark.createDataFrame([], "key string, lower double, upper double")
    good = {k: F.when(finite(F.col(k)), F.col(k)) for k in keys}
    wide = study.rows.agg(*(F.struct((F.min(c) + 0.0).alias("lower"), (F.max(c) + 0.0).alias("upper")).alias(k) for k, c in good.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"`{k}`.lower").alias("lower"), F.col(f"`{k}`.upper").alias("upper")) for k in keys))).alias("b")).select("b.*")


def fill_bounds(study: Study) -> None:
    """Give keys without bounds those observed."""
    missing = [k for k in study.manifest.keys if k.role in UNIT_ROLES and (k.lower is None or k.upper is None)]
    if not missing:
        return
    seen = {r.key: r for r in observed_bounds(study).collect()}
    for k in missing:
        k.lower = seen[k.name].lower if k.lower is None else k.lower
        k.upper = seen[k.name].upper if k.upper is None else k.upper


def bound_widths(study: Study) -> DataFrame:
    """(key, lower, upper, observed_lower, observed_upper, ratio, stale)."""
    declared = study.spark.createDataFrame([(k.name, k.lower, k.upper) for k in study.manifest.key_order() if k.role in UNIT_ROLES], "name string, lower double, upper double")
    seen = observed_bounds(study).withColumnsRenamed({"lower": "observed_lower", "upper": "observed_upper"})
    width = F.col("observed_upper") - F.col("observed_lower")
    ratio = F.when(width > 0, (F.col("upper") - F.col("lower")) / width)
    joined = declared.join(seen, F.col("name") == F.col("key")).select("key", "lower", "upper", "observed_lower", "observed_upper", ratio.alias("ratio"))
    return joined.withColumn("stale", F.coalesce(F.col("ratio") > STALE_RATIO, F.lit(False)))


def rows_per_support(study: Study) -> DataFrame:
    from fieldloom.operators.joins import support_of_rows

    return support_of_rows(study).groupBy("support").agg(F.count("*").alias("n"))


def first_three(bad: DataFrame, index: str = "row") -> DataFrame:
    """How many, and the first three indices, of rows already filtered."""
    ranked = bad.select(F.col(index).alias("i"))
    n = ranked.agg(F.count("*").alias("n_bad"))
    first = ranked.orderBy("i").limit(3).agg(F.sort_array(F.collect_list("i")).alias("first_three"))
    return n.join(first)


def distinct_units(study: Study) -> DataFrame:
    """(unit_id, unit, place): the units of generalisation in byte order of their names."""
    group = study.manifest.generalisation_group
    if group is None:
        raise StudyError("E18", "the study names no unit of generalisation")
    ids = study.rows.select(F.col(group).alias("unit_id")).distinct()
    named = decode_category(ids, "unit_id", study.entries(study.manifest.key(group).category), "unit")
    ranges = in_ranges(named.select("unit_id", "unit"), ["unit", "unit_id"], "__range")
    return numbered(ranges, ["unit", "unit_id"], "place", F.col("__range")).drop("__range")


def as_text(rows: list, columns: list[str]) -> str:
    """A small table of statistics in fixed width."""
    cells = [columns] + [[text_g6(v) if isinstance(v, float) else str(v) for v in (r[c] for c in columns)] for r in rows]
    widths = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(line, widths, strict=True)) for line in cells)
