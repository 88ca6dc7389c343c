"""A study as one wide table: a column per key, scalar and, for small supports, site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.joins import gather
from fieldloom.sources.study import Study

#: Columns of a wide table; beyond it a field stays an array.
MAX_COLUMNS = 2000


def wide_table(study: Study, slots: list[str] | None = None) -> DataFrame:
    """Keys and scalars of every row, with fields as arrays or as a column per site.

    A field is named after its support if there are more than one.
    """
    m = study.manifest
    out = study.rows
    for slot in m.arrays():
        if slot.source != "data" or slot.role not in ("field", "derived") or slot.statistic == "draw" or slots is not None and slot.name not in slots:
            continue
        name = f"{slot.support}_{slot.name}" if len(m.supports) > 1 else slot.name
        place = m.support(slot.support)
        n = (place.n_nodes if slot.location == "node" else place.n_cells) * (slot.components or 1)
        values = gather(study, slot).select(F.col("row").alias("__row"), F.col("values").alias("__values"))
        columns = [F.col("__values")[i].alias(f"{name}_{i}") for i in range(n)] if len(out.columns) + n <= MAX_COLUMNS else [F.col("__values").alias(name)]
        out = out.join(values, F.col("row") == F.col("__row"), "left").select(*out.columns, *columns)
    return out
