"""Rows in time along trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.access import at
from fieldloom.operators.joins import rows_with_instance
from fieldloom.sources.manifest import Slot
from fieldloom.sources.study import Study, StudyError


def time_key(study: Study):
    found = study.manifest.keys_of("time")
    if not found:
        raise StudyError("E03", "the study has no time key")
    return found[0]


def time_violations(rows: DataFrame, time: str, group: str | None) -> DataFrame:
    """(row, previous, time) where time doesn't grow along a trajectory, in row order.

    NaN doesn't grow, on either side.
    """
    order = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("row")
    back = rows.select("row", F.col(time).alias("time"), F.lag(time).over(order).alias("previous"))
    step = F.col("time") - F.col("previous")
    return back.where(F.col("previous").isNotNull() & (F.isnan(step) | (step <= 0))).select("row", "previous", "time")


def time_series(study: Study, slot: Slot, trajectory: int | None = None, node: int = 0, component: int = 0) -> DataFrame:
    """(row, t, v) of one site along a trajectory, in increasing time and then row order."""
    key = time_key(study)
    if slot.location == "row":
        rows = study.rows
        if trajectory is not None:
            rows = rows.where(F.col(key.trajectory_group) == trajectory)
        return rows.select("row", F.col(key.name).alias("t"), F.col(slot.name).alias("v")).orderBy("t", "row")
    rows = rows_with_instance(study, slot)
    if trajectory is not None:
        rows = rows.where(F.col(key.trajectory_group) == trajectory)
    width = {"node": "node", "cell": "cell"}[slot.location]
    value = at(study, slot, **{width: node, "component": component}).select(F.col("instance").alias("__of"), F.col("value").alias("v"))
    return rows.select("row", "instance", F.col(key.name).alias("t")).join(value, F.col("instance") == F.col("__of")).select("row", "t", "v").orderBy("t", "row")
