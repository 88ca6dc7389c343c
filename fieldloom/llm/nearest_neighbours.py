"""Approximate nearest neighbours: NN-descent and greedy graph search.

Equal vectors are one node.  The neighbour graph starts from small blocks of
nodes, one set of random blocks and ``TABLES`` orderings by random hyperplanes,
each compared within itself.  Then every node introduces its neighbours, in both
directions, to one another (the join of neighbours of neighbours), and each
keeps its ``degree`` nearest, until hardly any list changes.

A query starts at its own node's neighbours and always expands the nearest
nodes that it hasn't expanded, until its ``beam`` nearest are all expanded.

All nodes are indexed.  A block or a meeting never holds more than ``BLOCK``
nodes; of a larger meeting every node takes part, in random blocks.  Measured
recall is in the README.

Edge cases: vectors that are null, empty or zero, or hold a null or non-finite
component, are neither queries nor candidates; vectors of different length are
never compared; rows with one id and vector count once; ties go to the smaller
id; a query with fewer candidates gets them all; other columns are ignored.  A
query whose part of the graph holds too few nodes (as where few vectors have its
length) is compared with all nodes of its length, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.staging import checkpointed

BLOCK = 256
TABLES = 4
PLANES = 24
_EDGES = "u long, v long, d double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(rows), size)


def _distances(x: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * (x @ x.T), 0))


def _blocks(batches: Iterator[pa.RecordBatch], key: str | None) -> Iterator[pa.RecordBatch]:
    """The rows cut into pieces of BLOCK at most, none across a change of ``key``."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None or not rest.num_rows else pa.concat_tables([rest, table])
        if key is None:
            whole = rest.num_rows // BLOCK * BLOCK
        else:
            keys = rest[key].to_numpy()
            whole = int(np.argmax(keys == keys[-1])) if len(keys) else 0
        yield from _cut(rest.slice(0, whole), key)
        rest = rest.slice(whole)
    if rest is not None:
        yield from _cut(rest, key)


def _cut(table: pa.Table, key: str | None) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    batch = table.combine_chunks().to_batches()[0]
    keys = np.zeros(batch.num_rows) if key is None else batch[key].to_numpy()
    bounds = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), batch.num_rows)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        pieces = max(1, -(-(b - a) // BLOCK))
        for piece in np.array_split(np.arange(a, b), pieces):
            yield batch.slice(int(piece[0]), len(piece))


def _block_neighbours(degree: int, key: str | None):
    """The nearest within each block: rows u, v, d."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, key):
            ids, vectors = block["node"].to_numpy(), block["vector"]
            sizes = np.array([len(v) for v in vectors]) if block.num_rows else np.zeros(0)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if len(rows) < 2:
                    continue
                d = _distances(_matrix(vectors, rows, int(size)))
                np.fill_diagonal(d, np.inf)
                k = min(degree, len(rows) - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], k)), pa.array(ids[rows][near].ravel()), pa.array(np.take_along_axis(d, near, 1).ravel())], ["u", "v", "d"])

    return compare


def nearest_of(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest of every node, without repeats."""
    order = Window.partitionBy("u").orderBy("d", "v")
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= degree).drop("place")


def first_graph(nodes: DataFrame, count: int, degree: int, seed: int = 3) -> DataFrame:
    """Neighbours within random blocks and within orderings by hyperplanes."""
    parts = max(1, min(4096, count // (8 * BLOCK)))
    groups = max(1, count // BLOCK)
    random = nodes.withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(groups)))
    found = random.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_block_neighbours(degree, "bucket"), _EDGES)
    for table in range(TABLES):

        def place(batches: Iterator[pa.RecordBatch], table: int = table) -> Iterator[pa.RecordBatch]:
            planes: dict[int, np.ndarray] = {}
            for batch in batches:
                vectors = batch["vector"]
                sizes = np.array([len(v) for v in vectors])
                code, tail = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    if size not in planes:
                        planes[size] = np.random.default_rng((seed, table, int(size))).normal(size=(int(size), PLANES + 1))
                    side = _matrix(vectors, rows, int(size)) @ planes[size]
                    code[rows] = ((side[:, :PLANES] > 0) << np.arange(PLANES - 1, -1, -1)).sum(axis=1) + (int(size) << PLANES)
                    tail[rows] = side[:, PLANES]
                yield pa.RecordBatch.from_arrays([batch["node"], vectors, pa.array(code), pa.array(tail)], ["node", "vector", "code", "tail"])

        placed = nodes.mapInArrow(place, f"node long, vector {nodes.schema['vector'].dataType.simpleString()}, code long, tail double")
        ordered = placed.repartitionByRange(parts, "code", "tail").sortWithinPartitions("code", "tail")
        found = found.unionByName(ordered.mapInArrow(_block_neighbours(degree, None), _EDGES))
    return nearest_of(found, degree)


def introduce(edges: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """Pairs that meet at a common neighbour and are nearer than a list's last: u, v, d.

    ``edges``: u, v, d, fresh.  Of two neighbours one at least must be fresh.
    """
    last = edges.groupBy("u").agg(F.max("d").alias("last"), F.count("*").alias("full"))
    meet = edges.select(F.col("u").alias("host"), F.col("v").alias("guest"), "fresh").unionByName(edges.select(F.col("v").alias("host"), F.col("u").alias("guest"), "fresh"))
    meet = meet.groupBy("host", "guest").agg(F.max("fresh").alias("fresh"))
    known = nodes.join(last, F.col("node") == F.col("u"), "left").select("node", "vector", F.coalesce("last", F.lit(float("inf"))).alias("last"))
    rows = meet.join(known, F.col("guest") == F.col("node")).select("host", "node", "fresh", "last", "vector")

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ds = [], [], []
        for block in _blocks(batches, "host"):
            fresh = block["fresh"].to_numpy(zero_copy_only=False).astype(bool)
            if not fresh.any() or block.num_rows < 2:
                continue
            ids, last_d, vectors = block["node"].to_numpy(), block["last"].to_numpy(), block["vector"]
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) % block.num_rows:
                continue
            d = _distances(flat.reshape(block.num_rows, -1))
            good = (d < last_d[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            us.append(ids[i])
            vs.append(ids[j])
            ds.append(d[i, j])
            if sum(map(len, us)) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ds)], ["u", "v", "d"])
                us, vs, ds = [], [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ds)], ["u", "v", "d"])

    shuffled = F.xxhash64("node", "host")
    return rows.repartition(parts, "host").sortWithinPartitions("host", shuffled).mapInArrow(meeting, _EDGES)


def build_graph(nodes: DataFrame, degree: int, rounds: int, parts: int) -> DataFrame:
    """(u, v, d): the neighbour lists after NN-descent."""
    count = nodes.count()
    edges = checkpointed(first_graph(nodes, count, degree).withColumn("fresh", F.lit(True)))
    for _ in range(rounds):
        met = introduce(edges, nodes, parts).unionByName(edges.select("u", "v", "d"))
        kept = nearest_of(met, degree)
        old = edges.select(F.col("u").alias("u0"), F.col("v").alias("v0"))
        edges = checkpointed(kept.join(old, (F.col("u") == F.col("u0")) & (F.col("v") == F.col("v0")), "left").select("u", "v", "d", F.col("u0").isNull().alias("fresh")))
        if edges.where("fresh").count() <= 0.005 * degree * count:
            break
    return edges.select("u", "v", "d")


def greedy_search(starts: DataFrame, graph: DataFrame, nodes: DataFrame, beam: int, width: int) -> DataFrame:
    """(q, node, d): what the queries have met; ``starts``: q, vector of query nodes."""
    around = checkpointed(graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    order = Window.partitionBy("q").orderBy("d", "node")

    def marked(met: DataFrame) -> DataFrame:
        """Adds ``go``: the nodes to expand next.  One job a round: the driver keeps something of each."""
        ranked = met.withColumn("place", F.row_number().over(order))
        waits = (F.col("place") <= beam) & ~F.col("done")
        turn = F.sum(waits.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return checkpointed(ranked.withColumn("go", waits & (turn <= width)).drop("place"))

    met = marked(starts.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("done")))
    while not met.where("go").isEmpty():  # ends, as every round expands nodes that weren't
        reached = met.where("go").select("q", "node").join(around, F.col("node") == F.col("u")).select("q", F.col("v").alias("node")).distinct()
        new = reached.join(met.select("q", "node"), ["q", "node"], "left_anti")
        vectors = nodes.select("node", F.col("vector").alias("there"))
        new = new.join(vectors, "node").join(starts, "q").select("q", "node", distance(F.col("vector"), F.col("there")).alias("d"), F.lit(False).alias("done"))
        met = marked(met.select("q", "node", "d", (F.col("done") | F.col("go")).alias("done")).unionByName(new))
    return met.select("q", "node", "d")


def compare_all(queries: DataFrame, nodes: DataFrame, keep: int, parts: int) -> DataFrame:
    """(q, node, d): the ``keep`` nearest of ``queries`` (q, vector) among all nodes of the same length, which are cut into ``parts`` blocks."""
    there = nodes.select("node", F.col("vector").alias("there"), F.size("vector").alias("length"), F.pmod(F.xxhash64("node"), F.lit(parts)).alias("block"))
    asked = queries.select("q", "vector", F.size("vector").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block"))
    found = asked.join(there, ["length", "block"]).select("q", "block", "node", distance(F.col("vector"), F.col("there")).alias("d"))
    for keys in (["q", "block"], ["q"]):
        order = Window.partitionBy(*keys).orderBy("d", "node")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")
    return found.select("q", "node", "d")


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, degree: int = 44, rounds: int = 7, beam: int = 96, width: int = 16, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``.

    Returns query_id, rank from 1, vec_id, score.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(column))).select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    # zeros of either sign are equal: so are the vectors that hold them
    same = F.transform("vector", lambda x: F.when(x == 0, F.lit(0)).otherwise(x))
    members = checkpointed(rows.withColumn("vector", same.cast(rows.schema["vector"].dataType)).groupBy("vector", "vec_id").agg(F.lit(1).alias("one")).withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where((F.col("place") <= k + 1) | (F.col("vec_id") % every == 0)).drop("one"))
    nodes = checkpointed(members.where("place = 1").select(F.col("vec_id").alias("node"), "vector", F.xxhash64("vector").alias("print")))
    graph = build_graph(nodes.select("node", "vector"), degree, rounds, parts)
    belongs = members.withColumn("print", F.xxhash64("vector")).join(nodes.select("print", F.col("vector").alias("own"), "node"), ["print"]).where(F.col("vector") == F.col("own")).select("vec_id", "node", "place")
    belongs = checkpointed(belongs)
    queries = belongs.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    starts = checkpointed(queries.select("q").distinct().join(nodes.select(F.col("node").alias("q"), "vector"), "q"))
    met = greedy_search(starts, checkpointed(graph), nodes.select("node", "vector"), beam, width)
    enough = met.groupBy("q").count().where(F.col("count") > k)
    short = checkpointed(starts.join(enough, "q", "left_anti"))
    if short.limit(1).count():
        met = met.join(short.select("q"), "q", "left_anti").unionByName(compare_all(short, nodes.select("node", "vector"), k + 1, parts))
    close = met.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))).where(F.col("place") <= k + 1).select("q", "node", F.col("d").alias("score"))
    found = queries.join(close, "q").join(belongs.where(F.col("place") <= k + 1).select("node", "vec_id"), "node").where(F.col("vec_id") != F.col("query_id"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
