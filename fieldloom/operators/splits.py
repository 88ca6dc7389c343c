"""Deterministic splits that never divide a unit, and a search for those that do."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.hashing import draw_hex
from fieldloom.functions.names import byte_order
from fieldloom.operators.joins import decode_category
from fieldloom.operators.ordering import numbered
from fieldloom.operators.statistics import distinct_units
from fieldloom.sources.study import Study, StudyError


def part_sizes(n_units: int, fractions: dict[str, float]) -> dict[str, int]:
    """Units of each part: largest remainders, and at least one each."""
    names = byte_order(fractions)
    total = math.fsum(fractions.values()) if fractions else 0.0
    if not names or min(fractions.values()) < 0 or total <= 0:
        raise ValueError("fractions must not be negative and must sum to more than zero")
    if n_units < len(names):
        raise ValueError(f"{n_units} units can't fill {len(names)} parts")
    shares = {p: fractions[p] / sum(fractions[q] for q in names) * n_units for p in names}
    sizes = {p: math.floor(shares[p]) for p in names}
    by_remainder = sorted(names, key=lambda p: -(shares[p] - sizes[p]))
    for p in by_remainder[: n_units - sum(sizes.values())]:
        sizes[p] += 1
    while min(sizes.values()) == 0:
        sizes[min(names, key=lambda p: sizes[p])] += 1
        sizes[max(names, key=lambda p: sizes[p])] -= 1
    return sizes


def deal_units(units: DataFrame, fractions: dict[str, float], seed: int, n_units: int | None = None) -> DataFrame:
    """``units``: unit_id, unit, place.  Adds ``part``.

    The units are sorted by their draws and dealt in blocks to the parts in
    name order.
    """
    sizes = part_sizes(units.count() if n_units is None else n_units, fractions)
    drawn = units.withColumn("draw", draw_hex(F.col("place"), seed))
    dealt = numbered(drawn, ["draw", "unit", "unit_id"], "turn", F.substring("draw", 1, 4))
    part, upto = F.lit(None).cast("string"), sum(sizes.values())
    for name in reversed(byte_order(sizes)):
        part = F.when(F.col("turn") < upto, F.lit(name)).otherwise(part)
        upto -= sizes[name]
    return dealt.withColumn("part", part)


def grouped_split(study: Study, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """(row, part): every row goes where its unit of generalisation goes."""
    units = deal_units(distinct_units(study), fractions, seed)
    group = study.manifest.generalisation_group
    return study.rows.select("row", F.col(group).alias("__unit")).join(units.select("unit_id", "part"), F.col("__unit") == F.col("unit_id")).select("row", "part")


def rows_of_part(study: Study, split: DataFrame, part: str) -> DataFrame:
    chosen = split.where(F.col("part") == part).select(F.col("row").alias("__row"))
    return study.rows.join(chosen, F.col("row") == F.col("__row"), "left_semi")


def split_leaks(study: Study, split_key: str | None = None) -> DataFrame:
    """(unit, parts): units that lie in more than one part of a stored split."""
    group = study.manifest.generalisation_group
    if group is None:
        raise StudyError("E18", "the study names no unit of generalisation")
    key = study.manifest.key(split_key) if split_key else study.manifest.keys_of("split")[0]
    pairs = study.rows.select(F.col(group).alias("unit_id"), F.col(key.name).alias("part_id")).distinct()
    leaking = decode_category(pairs, "part_id", study.entries(key.category), "part").groupBy("unit_id").agg(F.sort_array(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)
    return decode_category(leaking, "unit_id", study.entries(study.manifest.key(group).category), "unit").select("unit", "parts")
