"""Values by the names of their dimensions, never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.manifest import Slot
from fieldloom.sources.study import Study, StudyError

#: Names a caller may use, and the columns of the long view they mean.
AXES = {"row": "instance", "instance": "instance", "group": "instance", "draw": "draw", "node": "site", "cell": "site", "site": "site", "component": "component"}


def axis(slot: Slot, name: str) -> str:
    if name.startswith("group:"):
        if slot.varies != name:
            raise StudyError("E04", f"{slot.path} varies along {slot.varies}, not {name}")
        return "instance"
    if name not in AXES or name in ("node", "cell") and name != slot.location:
        raise StudyError("E04", f"{slot.path} has no axis {name}")
    return AXES[name]


def at(study: Study, slot: Slot, **where: int) -> DataFrame:
    """The long view at the named indices; axes not named come back whole.

    The instance is found in storage; a site and component are picked inside
    the payload, so that one value doesn't explode its whole array.
    """
    places = {axis(slot, name): value for name, value in where.items()}
    payload = study.payload(slot)
    for column in ("instance", "draw"):
        if column in places:
            payload = payload.where(F.col(column) == places[column])
    data = "labels" if slot.role == "label" else "values"
    width = slot.components or 1
    if "site" in places and "component" in places:
        index = places["site"] * width + places["component"]
        return payload.select("instance", "draw", F.lit(places["site"]).cast("bigint").alias("site"), F.lit(places["component"]).alias("component"), F.get(data, F.lit(index)).alias("value"))
    long = payload.select("instance", "draw", F.posexplode(data).alias("at", "value")).select("instance", "draw", F.expr(f"CAST(at DIV {width} AS BIGINT)").alias("site"), (F.col("at") % width).cast("int").alias("component"), "value")
    for column in ("site", "component"):
        if column in places:
            long = long.where(F.col(column) == places[column])
    return long


def transpose(study: Study, slot: Slot, *dims: str) -> DataFrame:
    """The long view with one column per named axis, in that order and sorted by it."""
    columns = [axis(slot, d) for d in dims]
    whole = {"instance", "site", "component"} | ({"draw"} if slot.statistic == "draw" else set())
    if set(columns) != whole:
        raise StudyError("E04", f"name every axis of {slot.path} once: {', '.join(sorted(whole))}")
    named = study.long(slot).select(*(F.col(c).alias(d.replace(":", "_")) for c, d in zip(columns, dims, strict=True)), "value")
    return named.orderBy(*(d.replace(":", "_") for d in dims))


def permute(study: Study, slot: Slot, *dims: str) -> DataFrame:
    """As transpose; an axis the slot lacks has length 1, and only one of length 1 may be left out."""
    long, out, used = study.long(slot), [], set()
    for d in dims:
        try:
            column = axis(slot, d)
        except StudyError:
            out.append(F.lit(0).alias(d))
            continue
        if column == "draw" and slot.statistic != "draw":
            out.append(F.lit(0).alias(d))
            continue
        used.add(column)
        out.append(F.col(column).alias(d.replace(":", "_")))
    left = {"instance", "site", "component"} - used
    if "component" in left and (slot.components or 1) > 1 or "site" in left or "instance" in left and slot.varies != "none":
        raise StudyError("E04", f"an axis of {slot.path} longer than 1 was left out")
    return long.select(*out, "value")
