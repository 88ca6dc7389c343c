"""Names, paths and the small grammars of attributes, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEGAL = r"^[A-Za-z0-9_.+-]+$"
#: Names that begin so belong to the container.
RESERVED = "fieldloom_"


def is_legal(name: str) -> bool:
    return re.fullmatch(LEGAL[1:-1], name) is not None and not name.startswith(RESERVED)


def legal_name(name: Column) -> Column:
    return name.rlike(LEGAL) & ~reserved_name(name)


def reserved_name(name: Column) -> Column:
    return name.startswith(RESERVED)


def byte_order(names) -> list[str]:
    """Names in the order of their UTF-8 bytes."""
    return sorted(names, key=lambda s: s.encode("utf-8"))


def stored_dimension(logical: Column) -> Column:
    """``group:k`` as ``group_k``; the others are stored as they are named."""
    return F.when(logical.startswith("group:"), F.concat(F.lit("group_"), F.substring(logical, 7, 1 << 30))).otherwise(logical)


def logical_dimension(stored: Column) -> Column:
    """The inverse; counted dimensions such as ``draw_3`` lose their count."""
    group = F.regexp_extract(stored, r"^group_(.+)$", 1)
    counted = F.regexp_extract(stored, r"^(draw|component)_[0-9]+$", 1)
    return F.when(group != "", F.concat(F.lit("group:"), group)).when(counted != "", counted).otherwise(stored)


def path_parts(path: Column) -> Column:
    """support, location and name of a slot path such as ``s0/node_arrays/p``."""
    parts = F.split(path, "/")
    return F.struct(parts[0].alias("support"), F.regexp_replace(parts[1], "_arrays$", "").alias("location"), F.element_at(parts, -1).alias("name"))


def source_parts(source: Column) -> Column:
    """kind (``data``, ``callable`` or null if neither) and the callable's id."""
    served = F.regexp_extract(source, r"^callable:(.+)$", 1)
    return F.struct(F.when(source == "data", F.lit("data")).when(served != "", F.lit("callable")).alias("kind"), F.when(served != "", served).alias("id"))


def varies_group(varies: str) -> str | None:
    """k of ``group:k``; None for ``none`` and ``row``; anything else is refused."""
    if varies in ("none", "row"):
        return None
    m = re.fullmatch(r"group:(.+)", varies)
    if m is None:
        raise ValueError(f"varies must be none, row or group:<key>, not {varies!r}")
    return m[1]


def reference_parts(reference: str) -> tuple[str, str, str | None]:
    """``row=3`` or ``group:member=wing_a`` as (kind, value, key)."""
    m = re.fullmatch(r"row=(\d+)|group:([^=]+)=(.+)", reference)
    if m is None:
        raise ValueError(f"reference must be row=<i> or group:<key>=<name>, not {reference!r}")
    return ("row", m[1], None) if m[1] is not None else ("group", m[3], m[2])


def text_17e(value: Column) -> Column:
    """A float with 17 exact digits after the point; the JVM's own format pads its shortest digits with zeros."""

    @F.pandas_udf("string")
    def exact(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.17e}", na_action="ignore")

    return exact(value.cast("double"))


def text_g6(value: float) -> str:
    return f"{value:.6g}"


def utc_stamp(text: Column) -> Column:
    """Whether a text is an ISO-8601 time in UTC."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|\+00:00)$"
    day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    clock = (F.substring(text, 12, 2).try_cast("int") < 24) & (F.substring(text, 15, 2).try_cast("int") < 60)
    return F.coalesce(text.rlike(shape) & day & clock, F.lit(False))
