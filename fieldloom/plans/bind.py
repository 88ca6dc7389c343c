"""The sample tables presented as studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbers import seconds
from fieldloom.operators.joins import category_table
from fieldloom.operators.ordering import numbered
from fieldloom.sources.manifest import Key, Manifest, Slot, Support
from fieldloom.sources.study import CATEGORIES, CELLS, SLOT_VALUES, Study, empty

CREATED = "2026-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(i).alias("id"), F.lit(v).alias("entry")) for i, v in enumerate(values)]
    # not from a local list, whose size Spark doesn't know: rows would be shuffled by a few keys to meet it
    return spark.range(1).select(F.inline(F.array(*rows)))


def _coded(frame: DataFrame, column: str, categories: DataFrame, to: str) -> DataFrame:
    side = categories.select(F.col("entry").alias("__entry"), F.col("id").alias(to))
    return frame.join(side, F.col(column) == F.col("__entry")).drop("__entry")


def events_tx(spark: SparkSession, sf_dir: str) -> Study:
    """Events as rows in time; the user is the unit and the trajectory."""
    events = table(spark, sf_dir, "events")
    types = category_table(events, "event_type", "event_type")
    users = events.select(F.col("user_id").cast("int").alias("id")).distinct().select(F.lit("user").alias("table_name"), "id", F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("entry"))
    status = _entries(spark, "status", ["converged", "failed", "running"])
    parts = _entries(spark, "split", ["test", "train"])
    rows = _coded(events, "event_type", types, "type_id").select(
        F.col("event_id").alias("row"),
        F.col("user_id").cast("int").alias("user"),
        seconds(F.col("ts")).alias("t"),
        F.col("type_id").cast("int").alias("event_type"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("int").alias("status"),
        F.when(F.col("event_id") % 5 == 0, 0).otherwise(1).cast("int").alias("split"),
        F.col("value").cast("double").alias("value"),
    )
    manifest = Manifest(
        created=CREATED,
        generalisation_group="user",
        keys=[Key("user", "group", category="user"), Key("t", "time", units="s", trajectory_group="user"), Key("event_type", "categorical", category="event_type"), Key("status", "status", category="status"), Key("split", "split", category="split")],
        slots=[Slot("value", "row", units="1")],
    )
    return Study(manifest, rows, empty(spark, SLOT_VALUES), empty(spark, CELLS), types.unionByName(users).unionByName(status).unionByName(parts))


def embed_axis(spark: SparkSession, sf_dir: str) -> Study:
    """Vectors as a field over an axis of 64 nodes, with four quarters and a band."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.col("vec_id").alias("row"), F.col("label").cast("int").alias("label"))
    wide = F.col("embedding").cast("array<double>")
    const = lambda slot, values, labels=None: spark.range(1).select(F.lit("axis").alias("support"), F.lit("node").alias("location"), F.lit(slot).alias("slot"), F.col("id").alias("instance"), F.lit(None).cast("int").alias("draw"), values.alias("values"), (labels if labels is not None else F.lit(None)).cast("array<bigint>").alias("labels"))
    field = lambda slot, values: vectors.select(F.lit("axis").alias("support"), F.lit("node").alias("location"), F.lit(slot).alias("slot"), F.col("vec_id").alias("instance"), F.lit(None).cast("int").alias("draw"), values.alias("values"), F.lit(None).cast("array<bigint>").alias("labels"))
    nodes = F.sequence(F.lit(0), F.lit(63))
    nothing = F.lit(None).cast("array<double>")
    payload = field("embedding", wide).unionByName(field("embedding_band", F.transform(wide, lambda x: F.abs(x) * 0.1)))
    payload = payload.unionByName(const("x", F.transform(nodes, lambda i: i.cast("double")))).unionByName(const("quarter", nothing, F.transform(nodes, lambda i: F.floor(i / 16).cast("bigint"))))
    quarters = _entries(spark, "quarter", ["q0", "q1", "q2", "q3"])
    labels = _entries(spark, "label", [f"l{i}" for i in range(10)])
    slots = [
        Slot("x", "node", "axis", "coordinates", "m", "none"),
        Slot("embedding", "node", "axis", "field", "1"),
        Slot("embedding_band", "node", "axis", "field", "1", statistic="band", of="embedding", level=0.95, method="tenth"),
        Slot("quarter", "node", "axis", "label", None, "none", category="quarter"),
    ]
    manifest = Manifest(created=CREATED, keys=[Key("label", "categorical", category="label")], slots=slots, supports=[Support("axis", "axis", 64)])
    return Study(manifest, rows, payload, empty(spark, CELLS), quarters.unionByName(labels))


def embed_draws(spark: SparkSession, sf_dir: str) -> Study:
    """A row per label; all its vectors are draws of one field."""
    vectors = numbered(table(spark, sf_dir, "embeddings"), ["vec_id"], "draw", within=("label",))
    payload = vectors.select(F.lit("axis").alias("support"), F.lit("node").alias("location"), F.lit("embedding").alias("slot"), F.col("label").cast("bigint").alias("instance"), F.col("draw").cast("int").alias("draw"), F.col("embedding").cast("array<double>").alias("values"), F.lit(None).cast("array<bigint>").alias("labels"))
    rows = vectors.select(F.col("label").cast("bigint").alias("row")).distinct()
    slots = [Slot("embedding", "node", "axis", "field", "1", statistic="draw")]
    return Study(Manifest(created=CREATED, slots=slots, supports=[Support("axis", "axis", 64)]), rows, payload, empty(spark, CELLS), empty(spark, CATEGORIES))


def lineitem_rows(spark: SparkSession, sf_dir: str) -> Study:
    """Order lines; the supplier is the unit."""
    lines = table(spark, sf_dir, "lineitem")
    flags = category_table(lines, "l_returnflag", "returnflag")
    states = category_table(lines, "l_linestatus", "linestatus")
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("table_name"), F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("entry"))
    coded = _coded(_coded(lines, "l_returnflag", flags, "flag_id"), "l_linestatus", states, "state_id")
    rows = coded.select(
        F.expr("l_orderkey * 8 + l_linenumber").alias("row"),
        F.col("l_suppkey").cast("int").alias("supplier"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
        F.col("flag_id").cast("int").alias("returnflag"),
        F.col("state_id").cast("int").alias("linestatus"),
    )
    keys = [Key("supplier", "group", category="supplier"), Key("quantity", "design", units="1"), Key("discount", "condition", units="1"), Key("returnflag", "categorical", category="returnflag"), Key("linestatus", "categorical", category="linestatus")]
    manifest = Manifest(created=CREATED, generalisation_group="supplier", keys=keys, slots=[Slot("price", "row", units="1"), Slot("tax", "row", units="1")])
    return Study(manifest, rows, empty(spark, SLOT_VALUES), empty(spark, CELLS), flags.unionByName(states).unionByName(suppliers))


def customer_family(spark: SparkSession, sf_dir: str) -> Study:
    """Customers whose nation has a node array of four values; regions are parents."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.select(F.col("c_custkey").alias("row"), F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.col("c_acctbal").alias("balance"))
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("n_nationkey") * 10.0 + i)
    payload = nations.select(F.lit("line").alias("support"), F.lit("node").alias("location"), F.lit("profile").alias("slot"), F.col("n_nationkey").cast("bigint").alias("instance"), F.lit(None).cast("int").alias("draw"), values.alias("values"), F.lit(None).cast("array<bigint>").alias("labels"))
    categories = nations.select(F.lit("nation").alias("table_name"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("entry")).unionByName(regions.select(F.lit("region").alias("table_name"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("entry")))
    keys = [Key("nation", "group", category="nation", parent="region"), Key("region", "group", category="region")]
    slots = [Slot("balance", "row", units="1"), Slot("profile", "node", "line", "field", "1", "group:nation")]
    manifest = Manifest(created=CREATED, generalisation_group="nation", keys=keys, slots=slots, supports=[Support("line", "axis", 4)])
    return Study(manifest, rows, payload, empty(spark, CELLS), categories)


def part_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as nodes of a sheared grid, 20 wide, and the quadrilaterals between them.

    Returns cells (cell, cell_type, nodes) and points (node, x, y, z, price, kind).
    """
    parts = table(spark, sf_dir, "part")
    col, line = F.col("node") % 20, F.floor(F.col("node") / 20).cast("double")
    points = parts.select(F.col("p_partkey").alias("node"), "p_size", F.col("p_retailprice").alias("price"), F.col("p_type").alias("kind"))
    points = points.select("node", (col + F.col("p_size") * 0.001).alias("x"), line.alias("y"), F.lit(0.0).alias("z"), "price", "kind")
    inner = parts.where((F.col("p_partkey") % 20 < 19) & (F.col("p_partkey") >= 20)).select((F.col("p_partkey") - 20).alias("at"))
    cells = inner.select((F.floor(F.col("at") / 20) * 19 + F.col("at") % 20).alias("cell"), F.lit(9).cast("smallint").alias("cell_type"), F.array("at", F.col("at") + 1, F.col("at") + 21, F.col("at") + 20).alias("nodes"))
    return cells, points


def orders_unaligned(spark: SparkSession, sf_dir: str) -> Study:
    """Orders on two axes, of 7 and of 4 nodes, by the parity of their key."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 2).cast("int").alias("support_ix"))
    placed = orders.select(F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 2).cast("int").alias("support_ix"), "o_totalprice")
    placed = numbered(placed, ["row"], "instance", within=("support_ix",))
    size = F.when(F.col("support_ix") == 0, 7).otherwise(4)
    payload = placed.select(F.when(F.col("support_ix") == 0, "long").otherwise("short").alias("support"), F.lit("node").alias("location"), F.lit("load").alias("slot"), "instance", F.lit(None).cast("int").alias("draw"), F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("o_totalprice") + i).alias("values"), F.lit(None).cast("array<bigint>").alias("labels"))
    manifest = Manifest(created=CREATED, aligned=False, slots=[Slot("load", "node", s, "field", "1") for s in ("long", "short")], supports=[Support("long", "axis", 7), Support("short", "axis", 4)])
    return Study(manifest, rows, payload, empty(spark, CELLS), empty(spark, CATEGORIES))


# A worked affine model of two keys with its constant bands.
MODEL = {
    "cl": {"A": [[2.0, 0.1]], "b": [0.05], "shape": [1], "uncertainty": [0.02], "level": 0.95, "method": "constant band"},
    "pressure": {"A": [[1.0, 0.0], [2.0, 0.0], [3.0, 0.5], [4.0, 0.5], [5.0, 1.0], [6.0, 1.0]], "b": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5], "shape": [6, 1], "uncertainty": [0.05, 0.10, 0.15, 0.20, 0.25, 0.30], "level": 0.68, "method": "constant band"},
}


def orders_model(spark: SparkSession) -> Study:
    """A study of no rows whose slots an affine model of discount and quantity serves."""
    from fieldloom.operators.codec import encode
    from fieldloom.operators.models import Affine
    from fieldloom.sources.manifest import Model

    model = Affine(["discount", "quantity"], MODEL)
    slots = [Slot("cl", "row", units="1", source="callable:m1", output="cl"), Slot("cl_band", "row", units="1", statistic="band", of="cl", source="callable:m1", output="cl")]
    slots += [Slot("pressure", "node", "six", "field", "Pa", source="callable:m1", output="pressure"), Slot("pressure_band", "node", "six", "field", "Pa", statistic="band", of="pressure", source="callable:m1", output="pressure")]
    manifest = Manifest(created=CREATED, keys=[Key("discount", "condition", units="1", lower=0.0, upper=0.1), Key("quantity", "design", units="1", lower=1.0, upper=50.0)], slots=slots, supports=[Support("six", "axis", 6)], models=[Model("m1", model.type, encode(model.to_dict()))])
    return Study(manifest, spark.createDataFrame([], "row bigint, discount double, quantity double"), empty(spark, SLOT_VALUES), empty(spark, CELLS), empty(spark, CATEGORIES))
