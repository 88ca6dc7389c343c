"""Connected components of a table of links: within parts first, then by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.staging import checkpointed, stored

#: Links that a task joins at once; so many are a part.
PART_LINKS = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links that aren't the smallest of their component, and that smallest one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        of_a, of_b = root[a], root[b]
        apart = of_a != of_b
        if not apart.any():
            break
        a, b, of_a, of_b = a[apart], b[apart], of_a[apart], of_b[apart]
        np.minimum.at(root, np.maximum(of_a, of_b), np.minimum(of_a, of_b))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(root)))
    return names[other], names[root[other]]


def joined_in_parts(edges: DataFrame, part_links: int) -> DataFrame:
    """(node, low) with the components of ``edges``, of which each task makes stars of at most ``part_links`` links at once."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(node: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], ["node", "low"])

        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, part_links):
                links = [x.to_numpy(zero_copy_only=False) for x in batch.slice(k, part_links).columns]
                if n + len(links[0]) > part_links:
                    stars = _stars(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [stars], len(stars[0])
                    if n > part_links // 2:  # few of them were repeats
                        yield made(*stars)
                        held, n = [], 0
                held.append(links)
                n += len(links[0])
        if held:
            yield made(*_stars(*map(np.concatenate, zip(*held, strict=True))))

    return edges.mapInArrow(join, "node long, low long")


def _with_root(edges: DataFrame) -> DataFrame:
    """Adds ``root``, the smallest ``low`` of the node: summed up before the shuffle, then joined."""
    least = edges.groupBy(F.col("node").alias("of")).agg(F.min("low").alias("root"))
    return edges.join(least, F.col("node") == F.col("of")).select("node", "low", "root")


def _settled(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Stars of the whole components, by rounds of large and small star."""
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("low").alias("node"), F.col("node").alias("low")))
        large = _with_root(both).where("low > node").select(F.col("low").alias("node"), F.least("node", "root").alias("low")).where("node <> low").distinct()
        small = _with_root(large)
        edges = checkpointed(small.select("node", F.col("root").alias("low")).unionByName(small.select(F.col("low").alias("node"), F.col("root").alias("low"))).where("node <> low").distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "low").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == tuple(state):
            return edges
        mark = tuple(state)
    raise RuntimeError("components did not settle")


def connected_components(links: DataFrame, max_rounds: int = 64, part_links: int = 0) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is its smallest node.

    Tasks first join the links that they read, and what is left is dealt to one
    task for each ``part_links`` of it.  One part is then done: a few links
    don't take a task and a file for each shuffle partition.  With more parts, each
    round points every node at the smallest node it knows (large star, then small
    star) and is written to the checkpoint folder.  Self-links and repeats are
    ignored; no links give an empty table.
    """
    most = part_links or PART_LINKS
    edges = stored(joined_in_parts(links.where("a <> b").select("a", "b"), most))
    parts = -(-edges.count() // most)
    if parts:
        edges = stored(joined_in_parts(edges.coalesce(parts), most))
    if parts > 1:
        edges = _settled(edges, max_rounds)
    return edges.select("node", F.col("low").alias("component")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
