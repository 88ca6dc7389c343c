"""Appending a stream of rows to a stored study.

Each micro-batch is appended with ``append_rows`` and published as a new
version, so a failed batch leaves the study as it was.  The growth of time along
a trajectory is checked within a batch, and across batches by joining each
trajectory's last time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.operators.mutate import append_rows
from fieldloom.operators.trajectory import time_key
from fieldloom.sources.study import Study, StudyError, open_study, write_study


def falls_back(own: Study, batch: DataFrame) -> DataFrame:
    """Rows of the batch whose time isn't after the one before: in the batch, or stored last."""
    key = time_key(own)
    order = Window.partitionBy(key.trajectory_group).orderBy("row")
    last = own.rows.groupBy(F.col(key.trajectory_group).alias("__group")).agg(F.max_by(key.name, "row").alias("__last"))
    met = batch.withColumn("__back", F.lag(key.name).over(order)).withColumn("__nth", F.row_number().over(order)).join(last, F.col(key.trajectory_group).eqNullSafe(F.col("__group")), "left")
    before = F.when(F.col("__nth") == 1, F.col("__last")).otherwise(F.col("__back"))
    step = F.col(key.name) - before
    first = (F.col("__nth") == 1) & F.col("__group").isNull()  # a trajectory's first row of all
    return met.where(~first & F.coalesce(F.isnan(step) | (step <= 0), F.lit(True))).select("row")


def append_batch(path: str, to_study: Callable[[DataFrame], Study], replace_by: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: turns a frame into a study and appends it.

    The number of the last batch is kept in the study's notes, so that a batch
    that is delivered again is passed by.
    """

    def append(frame: DataFrame, batch: int) -> None:
        own = open_study(frame.sparkSession, path)
        if int(own.manifest.notes.get("last_batch", -1)) >= batch:
            return
        more = to_study(frame)
        if own.manifest.keys_of("time") and replace_by is None and falls_back(own, more.rows).limit(1).count():
            raise StudyError("E09", f"batch {batch} goes back in time")
        made = append_rows(own, more, replace_by)
        write_study(made.with_manifest(notes=made.manifest.notes | {"last_batch": str(batch)}), path, check=False)

    return append


def start_append(stream: DataFrame, path: str, checkpoint: str, to_study: Callable[[DataFrame], Study], replace_by: str | None = None) -> StreamingQuery:
    """Append a streaming frame until it is stopped."""
    return stream.writeStream.foreachBatch(append_batch(path, to_study, replace_by)).option("checkpointLocation", checkpoint).start()
