"""Digests of stored supports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.hashing import SupportDigest
from fieldloom.sources.study import Study


def _packed(ordered: DataFrame, column: str, kind: str) -> Iterator[bytes]:
    """The column's numbers as blocks of bytes, packed in the tasks, in the frame's order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            flat = values.flatten() if pa.types.is_list(values.type) else values
            yield pa.RecordBatch.from_arrays([pa.array([flat.to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary())], ["block"])

    for r in ordered.select(column).mapInArrow(pack, "block binary").toLocalIterator():
        yield r.block


def digest_of(study: Study, support: str) -> str:
    """SHA-256 over a support's connectivity (and an axis's coordinates).

    A digest reads its bytes in one order, so the columns stream through the
    driver in that order, in blocks that the tasks packed, and never all held.
    """
    place = study.manifest.support(support)
    digest = SupportDigest(place.n_nodes)
    if place.kind == "mesh":
        ordered = study.cells.where(F.col("support") == support).orderBy("cell").select((F.col("cell_type").cast("int") % 256).alias("code"), F.size("nodes").cast("long").alias("k"), "nodes")
        sha = digest._sha
        for block in _packed(ordered, "code", "<u1"):
            sha.update(block)
        offset = 0
        sha.update(np.array([0], dtype="<i8").tobytes())
        for block in _packed(ordered, "k", "<i8"):
            offsets = np.cumsum(np.frombuffer(block, dtype="<i8")) + offset
            sha.update(offsets.astype("<i8").tobytes())
            offset = int(offsets[-1]) if len(offsets) else offset
        for block in _packed(ordered, "nodes", "<i8"):
            sha.update(block)
    elif place.kind == "axis":
        slot = next((s for s in study.manifest.arrays() if s.support == support and s.role == "coordinates"), None)
        if slot is not None:
            for r in study.payload(slot).orderBy("instance").select("instance", "values").toLocalIterator():
                digest.axis(r["values"])
    return digest.hexdigest()


def support_ids(study: Study) -> dict[str, str]:
    return {name: digest_of(study, name) for name in study.manifest.support_order()}
