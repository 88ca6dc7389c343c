"""The registered queries: each applies an operator to the sample tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import names
from fieldloom.functions.names import path_parts
from fieldloom.functions.numbers import finite
from fieldloom.functions.units import units_dimensions
from fieldloom.operators import access, geometry, joins, models, mutate, splits, statistics, trajectory
from fieldloom.operators.integrate import integrate
from fieldloom.operators.ordering import running_sum
from fieldloom.operators.supports import support_ids
from fieldloom.plans import bind, rules, sample_models
from fieldloom.plans.rules import check_offsets
from fieldloom.sources.manifest import Key, Manifest, Slot, Support
from fieldloom.sources.study import CATEGORIES, SLOT_VALUES, Study, empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def stats():
    return ["count", "n_missing", *r6("min", "max", "mean", "std")]


# statistics


@query
def scalar_stats_by_category(spark, d):
    return statistics.scalar_statistics(bind.events_tx(spark, d), "value", "event_type").select("event_type", *stats())


@query
def scalar_stats_all(spark, d):
    return statistics.scalar_statistics(bind.lineitem_rows(spark, d), "price").select(*stats())


@query
def field_stats_row(spark, d):
    s = bind.embed_axis(spark, d)
    return statistics.field_statistics(s, s.manifest.find("embedding")).select("row", *stats())


@query
def field_stats_label(spark, d):
    s = bind.embed_axis(spark, d)
    return statistics.field_statistics(s, s.manifest.find("embedding"), by="quarter").select("row", "quarter", *stats())


@query
def field_stats_pooled(spark, d):
    s = bind.embed_axis(spark, d)
    return statistics.pooled_statistics(s, s.manifest.find("embedding"), by="quarter").select("quarter", *stats())


@query
def field_stats_by_instance(spark, d):
    s = bind.customer_family(spark, d)
    return statistics.field_statistics(s, s.manifest.find("profile"), per="instance").select(F.col("row").alias("nation"), *stats())


@query
def draw_summaries(spark, d):
    s = bind.embed_draws(spark, d)
    return statistics.draw_summaries(s, s.manifest.find("embedding"), 0.9).select(F.col("instance").alias("label"), "site", *r6("mean", "std", "quantile"))


@query
def bounds_observed(spark, d):
    return statistics.observed_bounds(bind.lineitem_rows(spark, d))


@query
def bounds_stale(spark, d):
    s = bind.lineitem_rows(spark, d)
    keys = [dataclasses.replace(k, lower=-1000.0, upper=1000.0) if k.name == "discount" else dataclasses.replace(k, lower=0.0, upper=60.0) if k.name == "quantity" else k for k in s.manifest.keys]
    return statistics.bound_widths(s.with_manifest(keys=keys)).select("key", *r6("ratio"), "stale")


@query
def rows_per_support(spark, d):
    return statistics.rows_per_support(bind.orders_unaligned(spark, d))


# integration and geometry


@query
def integrate_axis(spark, d):
    s = geometry.with_weights(bind.embed_axis(spark, d), "axis")
    return integrate(s, s.manifest.find("embedding")).select("row", *r6("integral"), "n_missing")


@query
def integrate_region(spark, d):
    s = geometry.with_weights(bind.embed_axis(spark, d), "axis")
    return integrate(s, s.manifest.find("embedding"), by="quarter", region="q1").select("row", *r6("integral"))


@query
def cell_measure(spark, d):
    cells, points = bind.part_mesh(spark, d)
    return geometry.corner_points(cells, points.select("node", "x", "y", "z")).select("cell", F.round(geometry.cell_measure(F.col("pts"), F.col("cell_type")), 9).alias("area"))


def _node_weights(spark, d):
    cells, points = bind.part_mesh(spark, d)
    measures = geometry.corner_points(cells, points.select("node", "x", "y", "z")).select(F.lit(0).alias("instance"), "cell", geometry.cell_measure(F.col("pts"), F.col("cell_type")).alias("measure"))
    return geometry.lump(measures, cells), points


@query
def node_weights(spark, d):
    return _node_weights(spark, d)[0].select("node", F.round("weight", 9).alias("weight"))


@query
def integrate_mesh(spark, d):
    weights, points = _node_weights(spark, d)
    met = points.select(F.col("node").alias("__node"), "price", "kind").hint("merge").join(weights, F.col("node") == F.col("__node"))
    good = F.when(finite(F.col("price")), F.col("price") * F.col("weight"))
    return met.groupBy("kind").agg(F.round(F.sum(good), 4).alias("integral"), F.round(F.sum("weight"), 6).alias("area"))


@query
def offsets_running(spark, d):
    cells, _ = bind.part_mesh(spark, d)
    return running_sum(cells, ["cell"], F.size("nodes"), "offset").select("cell", "offset")


@query
def derived_displacement(spark, d):
    s = bind.customer_family(spark, d)
    moved = mutate.derived_difference(s.payload(s.manifest.find("profile")).select("instance", "values"), 3)
    return moved.select("instance", F.posexplode("values").alias("node", "value")).select("instance", F.col("node").cast("bigint").alias("node"), "value")


# gathers and access by name


@query
def gather_group_varying(spark, d):
    s = bind.customer_family(spark, d)
    seen = joins.gather(s, s.manifest.find("profile"), ["nation", "region"])
    named = joins.decode_category(joins.decode_category(seen, "nation", s.entries("nation"), "nation_name"), "region", s.entries("region"), "region_name")
    return named.select("row", "nation_name", "region_name", F.posexplode("values").alias("node", "value")).select("row", "nation_name", "region_name", F.col("node").cast("bigint").alias("node"), "value")


@query
def group_parents(spark, d):
    return joins.parents(bind.customer_family(spark, d), "nation").select(F.col("nation").cast("bigint").alias("nation"), F.col("region").cast("bigint").alias("region"))


@query
def unaligned_ordinal(spark, d):
    s = bind.orders_unaligned(spark, d)
    out = None
    for name in ("long", "short"):
        part = joins.gather(s, s.manifest.find(f"{name}/load")).select("row", F.lit(name).alias("support"), "instance", F.posexplode("values").alias("node", "value"))
        out = part if out is None else out.unionByName(part)
    return out.select("row", "support", "instance", F.col("node").cast("bigint").alias("node"), F.round("value", 6).alias("value"))


@query
def rows_on_support(spark, d):
    return joins.rows_on(bind.orders_unaligned(spark, d), "short").select("row", "ordinal")


@query
def at_probe(spark, d):
    s = bind.embed_axis(spark, d)
    return access.at(s, s.manifest.find("axis/node_arrays/embedding"), node=17, component=0).select(F.col("instance").alias("row"), "value")


@query
def row_range(spark, d):
    s = bind.embed_axis(spark, d)
    return s.long(s.manifest.find("embedding"), 100, 200).select(F.col("instance").alias("row"), F.col("site").alias("node"), "value")


@query
def transpose_named(spark, d):
    s = bind.embed_axis(spark, d)
    return access.transpose(s, s.manifest.find("embedding"), "node", "component", "row").select("node", F.col("component").cast("bigint").alias("component"), "row", "value")


@query
def permute_added_axis(spark, d):
    s = bind.customer_family(spark, d)
    return access.permute(s, s.manifest.find("profile"), "draw", "node", "instance").select(F.col("draw").cast("bigint").alias("draw"), "node", "instance", "value")


@query
def time_series_scalar(spark, d):
    s = bind.events_tx(spark, d)
    return trajectory.time_series(s, s.manifest.find("value"), trajectory=3).select("row", "t", "v")


@query
def time_series_node(spark, d):
    s = bind.customer_family(spark, d)
    keyed = s.replace(rows=s.rows.withColumn("t", F.col("row").cast("double"))).with_manifest(keys=[*s.manifest.keys, Key("t", "time", units="s", trajectory_group="region")])
    return trajectory.time_series(keyed, keyed.manifest.find("profile"), trajectory=2, node=1).select("row", "t", "v")


@query
def scalar_range(spark, d):
    return bind.events_tx(spark, d).scalar_column("value", 50, 150)


# categories


@query
def category_encode(spark, d):
    lines = bind.table(spark, d, "lineitem")
    table = joins.category_table(lines, "l_returnflag", "returnflag")
    coded = joins.encode_category(lines.select("l_returnflag"), "l_returnflag", table, "id")
    return coded.groupBy("id").agg(F.count("*").alias("n")).select(F.col("id").cast("bigint").alias("id"), "n")


@query
def category_decode(spark, d):
    s = bind.lineitem_rows(spark, d)
    counted = s.rows.groupBy("returnflag").agg(F.count("*").alias("n"))
    # one entry is left out, so that its id falls back to digits
    return joins.decode_category(counted, "returnflag", s.entries("returnflag").where("entry <> 'N'"), "entry").select("entry", "n")


@query
def category_map(spark, d):
    types = joins.category_table(bind.table(spark, d, "events"), "event_type", "event_type")
    other = types.where("entry <> 'click'").withColumn("id", F.col("id") * 10)
    return joins.map_categories(types, other).select(F.col("from_id").cast("bigint").alias("from_id"), F.col("to_id").cast("bigint").alias("to_id"), "entry")


@query
def status_filter(spark, d):
    return joins.converged(bind.events_tx(spark, d)).select("row", "value")


@query
def bounds_filter(spark, d):
    rows = bind.lineitem_rows(spark, d).rows
    return rows.where(~joins.outside_bounds(F.col("quantity"), 10.0, 20.0)).groupBy("returnflag").agg(F.count("*").alias("n")).select(F.col("returnflag").cast("bigint").alias("returnflag"), "n")


@query
def bounds_intersection(spark, d):
    lines = bind.table(spark, d, "lineitem")
    per = lines.groupBy(F.col("l_linestatus").alias("model")).agg(F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.min("l_extendedprice").alias("p0"), F.max("l_extendedprice").alias("p1"))
    bounds = per.select("model", F.explode(F.array(F.struct(F.lit("quantity").alias("key"), F.col("q0").alias("lower"), F.col("q1").alias("upper")), F.struct(F.lit("price").alias("key"), F.col("p0").alias("lower"), F.col("p1").alias("upper")))).alias("b")).select("model", "b.*")
    return joins.bounds_intersection(bounds)


# splits


@query
def grouped_split(spark, d):
    s = bind.lineitem_rows(spark, d)
    units = splits.deal_units(statistics.distinct_units(s), {"train": 0.8, "test": 0.2}, seed=0)
    sizes = s.rows.groupBy(F.col("supplier").alias("__unit")).agg(F.count("*").alias("n_rows"))
    return units.join(sizes, F.col("unit_id") == F.col("__unit")).select("unit", "part", "n_rows")


@query
def split_rows(spark, d):
    s = bind.events_tx(spark, d)
    return splits.grouped_split(s, {"train": 0.7, "test": 0.2, "validation": 0.1}, seed=7)


@query
def split_leaks(spark, d):
    return splits.split_leaks(bind.events_tx(spark, d)).select("unit", F.array_join("parts", ",").alias("parts"))


# models


def _keys(spark, d):
    return bind.table(spark, d, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("row"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"))


@query
def affine_evaluate(spark, d):
    s = bind.orders_model(spark)
    keys = models.keys_table(s, _keys(spark, d))
    made = models.predictions(models.model_of(s, "m1"), keys, ["cl", "pressure"])
    return made.select("row", F.col("cl.mean")[0].alias("cl"), *(F.col("pressure.mean")[i].alias(f"p{i}") for i in range(6)))


@query
def affine_band(spark, d):
    s = bind.orders_model(spark)
    keys = models.keys_table(s, _keys(spark, d))
    made = models.predictions(models.model_of(s, "m1"), keys, ["cl"])
    return made.groupBy(F.col("cl.uncertainty")[0].alias("band"), F.col("cl.level").alias("level"), F.col("cl.method").alias("method")).agg(F.count("*").alias("n"))


@query
def registered_model(spark, d):
    made = models.predictions(models.load(sample_models.Ratio.type, {}), models.keys_table(bind.orders_model(spark), _keys(spark, d)), ["ratio"])
    return made.select("row", F.round(F.col("ratio.mean")[0], 9).alias("value"))


@query
def evaluate_slots(spark, d):
    s = bind.orders_model(spark)
    done = models.evaluate(s, bind.table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), ((F.col("o_orderkey") % 11) / 100).alias("discount"), (F.col("o_orderkey") % 50).cast("double").alias("quantity")))
    return done.payload(done.manifest.find("pressure")).select(F.col("instance").alias("row"), F.posexplode("values").alias("node", "value")).select("row", F.col("node").cast("bigint").alias("node"), "value")


@query
def distill_grid(spark, d):
    spread = bind.table(spark, d, "lineitem").agg(F.min("l_discount").alias("d0"), F.max("l_discount").alias("d1"), F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"))
    # a stated grid of 5 by 7 between the observed bounds
    grid = spread.select(F.explode(F.sequence(F.lit(0), F.lit(34))).alias("row"), "*")
    keys = grid.select("row", (F.col("d0") + (F.col("d1") - F.col("d0")) * F.floor(F.col("row") / 7) / 4).alias("discount"), (F.col("q0") + (F.col("q1") - F.col("q0")) * (F.col("row") % 7) / 6).alias("quantity"))
    s = bind.orders_model(spark)
    return models.predictions(models.model_of(s, "m1"), models.keys_table(s, keys), ["cl"]).select("row", F.round(F.col("cl.mean")[0], 9).alias("value"))


@query
def prediction_band(spark, d):
    s = bind.embed_axis(spark, d)
    predicted = models.prediction(s, s.manifest.find("embedding"))
    return models.interval(predicted).select("row", F.col("site").cast("bigint").alias("site"), *(F.round(c, 9).alias(c) for c in ("mean", "lower", "upper")))


# mutation


def _order_study(spark, rows, n):
    from fieldloom.sources.study import CELLS

    manifest = Manifest(created=bind.CREATED, n_rows=n, keys=[Key("id", "id"), Key("day", "condition", units="1")], slots=[Slot("price", "row", units="1")])
    return Study(manifest, rows, empty(spark, SLOT_VALUES), empty(spark, CELLS), empty(spark, CATEGORIES))


@query
def append_upsert(spark, d):
    orders = bind.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).cast("double").alias("day"), F.col("o_totalprice").alias("price"))
    n = orders.count()
    own = _order_study(spark, orders.select(F.col("id").alias("row"), "id", "day", "price"), n)
    changed = orders.where("id % 10 = 0").select(F.expr("id DIV 10").alias("row"), F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(F.col("id") + n).alias("id"), "day", (F.col("price") + 1000).alias("price"))
    made = mutate.append_rows(own, _order_study(spark, changed, changed.count()), replace_by="id")
    return made.rows.select("row", "id", "day", F.round("price", 6).alias("price"))


@query
def structural_diff(spark, d):
    customers = bind.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    other = customers.where("c_custkey % 50 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 40 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return mutate.table_difference(customers, other, ["c_custkey"])


# functions over columns


@query
def units_dims(spark, d):
    text = F.element_at(F.array(*map(F.lit, ["W m-2", "kg/(m s", "m s-1", "Pa", "furlong", "kg/(m s)", "1"])), (F.col("p_size") % 7 + 1).cast("int"))
    named = bind.table(spark, d, "part").select(text.alias("units"))
    return named.groupBy("units").agg(F.count("*").alias("n")).select("units", "n", units_dimensions(F.col("units")).alias("dims"))


@query
def path_columns(spark, d):
    path = F.concat(F.lit("s"), (F.col("c_nationkey") % 3).cast("string"), F.when(F.col("c_nationkey") % 2 == 0, "/node_arrays/").otherwise("/cell_arrays/"), F.col("c_mktsegment"))
    named = bind.table(spark, d, "customer").select(path_parts(path).alias("p"))
    return named.groupBy("p.support", "p.location", "p.name").agg(F.count("*").alias("n"))


@query
def chunk_default(spark, d):
    sizes = bind.table(spark, d, "part").select((F.col("p_size") * 8 * F.col("p_partkey")).alias("bytes_per_row"), (F.col("p_partkey") * 3).alias("n_rows"))
    rows = F.when(F.col("n_rows") == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.col("n_rows"), F.floor(F.lit(1 << 20) / F.greatest(F.lit(1), F.col("bytes_per_row"))))))
    return sizes.select("bytes_per_row", "n_rows", rows.cast("bigint").alias("chunk"))


# rules on values, each over data with a deterministic fault


def _rule(bad: DataFrame, rule: str, path: str, index: str) -> DataFrame:
    return bad.agg(F.count("*").alias("n_bad"), F.min(index).cast("bigint").alias("first_row")).select(F.lit(rule).alias("rule"), F.lit(path).alias("path"), "n_bad", "first_row")


def _found(study, rule: str, check) -> DataFrame:
    """What one pass of the validator says of one rule."""
    rows = [(f.rule, f.path, f.count, f.first_three[0]) for f in check(study) if f.rule == rule]
    return study.spark.createDataFrame(rows, "rule string, path string, n_bad bigint, first_row bigint")


@query
def rule_e05(spark, d):
    s = bind.embed_axis(spark, d)
    payload = s.slot_values.withColumn("values", F.when((F.col("slot") == "embedding") & (F.col("instance") % 97 == 5), F.slice("values", 1, 63)).otherwise(F.col("values")))
    return _found(s.replace(slot_values=payload), "E05", rules.payload_findings)


@query
def rule_e06(spark, d):
    s = bind.orders_unaligned(spark, d)
    rows = s.rows.withColumn("support_ix", F.when(F.col("row") % 1000 == 7, 2).otherwise(F.col("support_ix")))
    return _found(s.replace(rows=rows), "E06", rules.row_findings)


@query
def rule_e09(spark, d):
    s = bind.events_tx(spark, d)
    rows = s.rows.withColumn("t", F.when(F.col("row") % 100 == 99, F.col("t") - 1e9).when(F.col("row") % 100 == 50, F.lit(float("nan"))).otherwise(F.col("t")))
    return _found(s.replace(rows=rows), "E09", rules.row_findings)


@query
def rule_e10(spark, d):
    s = bind.events_tx(spark, d)
    return _rule(joins.unknown_categories(s.rows, "event_type", s.entries("event_type").where("id < 3")), "E10", "keys/event_type", "row")


@query
def rule_e16(spark, d):
    s = bind.orders_unaligned(spark, d)
    stored = s.payload(s.manifest.find("long/load")).where("instance % 100 <> 3").agg(F.count("*").alias("have"))
    want = s.rows.where("support_ix = 0").agg(F.count("*").alias("want"))
    return stored.join(want).where("have <> want").select(F.lit("E16").alias("rule"), F.lit("long/node_arrays/load").alias("path"), (F.col("want") - F.col("have")).alias("n_bad"), F.col("have").alias("first_row"))


def _bad_cells(spark, d):
    cells, points = bind.part_mesh(spark, d)
    kind = F.when(F.col("cell") % 50 == 9, 99).when(F.col("cell") % 50 == 10, 5).otherwise(F.col("cell_type")).cast("int")
    nodes = F.when(F.col("cell") % 50 == 11, F.transform("nodes", lambda n: n + 10_000_000)).otherwise(F.col("nodes"))
    made = cells.select(F.lit("mesh").alias("support"), "cell", kind.cast("smallint").alias("cell_type"), nodes.alias("nodes"))
    manifest = Manifest(created=bind.CREATED, supports=[Support("mesh", "mesh", points.count(), cells.count())])
    return Study(manifest, empty(spark, "row bigint"), empty(spark, SLOT_VALUES), made, empty(spark, CATEGORIES))


@query
def rule_e21(spark, d):
    return _found(_bad_cells(spark, d), "E21", rules.cell_findings)


@query
def rule_e22(spark, d):
    return _found(_bad_cells(spark, d), "E22", rules.cell_findings)


@query
def rule_e23(spark, d):
    offsets = offsets_running(spark, d).select((F.col("cell") + 1).alias("at"), F.when(F.col("cell") % 500 == 250, F.lit(1)).otherwise(F.col("offset")).alias("offset"))
    offsets = offsets.unionByName(spark.range(1).select(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("offset")))
    cells, _ = bind.part_mesh(spark, d)
    return _rule(check_offsets(offsets, cells.count() * 4), "E23", "mesh/cell_offsets", "at")


@query
def rule_e24(spark, d):
    return _found(_bad_cells(spark, d), "E24", rules.cell_findings)


@query
def rule_e34(spark, d):
    s = bind.customer_family(spark, d)
    have = s.payload(s.manifest.find("profile")).where("instance <> 4").select("instance")
    return _rule(s.entries("nation").join(have, F.col("id") == F.col("instance"), "left_anti"), "E34", "line/node_arrays/profile", "id")


@query
def rule_w01(spark, d):
    return _found(bind.events_tx(spark, d), "W01", rules.row_findings)


@query
def rule_w02(spark, d):
    return _found(bind.events_tx(spark, d), "W02", rules.row_findings)


@query
def rule_w03(spark, d):
    s = bind.events_tx(spark, d)
    rows = s.rows.withColumn("value", F.when(F.col("row") % 333 == 12, F.lit(float("nan"))).when(F.col("row") % 333 == 13, F.lit(float("inf"))).otherwise(F.col("value")))
    return _found(s.replace(rows=rows), "W03", rules.row_findings)


@query
def rule_w03_field(spark, d):
    s = bind.embed_axis(spark, d)
    payload = s.slot_values.withColumn("values", F.when((F.col("slot") == "embedding") & (F.col("instance") % 41 == 3), F.transform("values", lambda x: F.when(x > 0, x).otherwise(F.lit(float("nan"))))).otherwise(F.col("values")))
    return _found(s.replace(slot_values=payload), "W03", rules.payload_findings)


@query
def rule_w04(spark, d):
    s = bind.lineitem_rows(spark, d)
    keys = [dataclasses.replace(k, lower=5.0, upper=45.0) if k.name == "quantity" else k for k in s.manifest.keys]
    return _found(s.with_manifest(keys=keys), "W04", rules.row_findings)


@query
def rule_w07(spark, d):
    s = bind.customer_family(spark, d)
    return _found(s.replace(rows=s.rows.where("nation % 6 <> 5")), "W07", rules.row_findings)


@query
def rule_w08(spark, d):
    return _rule(bounds_stale(spark, d).where("stale").withColumn("at", F.lit(0)), "W08", "keys/discount", "at")


@query
def rule_w15(spark, d):
    s = bind.orders_unaligned(spark, d)
    names = spark.createDataFrame([(0, "long"), (1, "other"), (2, "short")], "ix int, name string")
    return _rule(names.join(s.rows.select((F.col("support_ix") * 2).alias("used")).distinct(), F.col("ix") == F.col("used"), "left_anti"), "W15", "supports", "ix")


@query
def rule_w16(spark, d):
    s = bind.embed_axis(spark, d)
    payload = s.slot_values.withColumn("values", F.when((F.col("slot") == "embedding_band") & (F.col("instance") % 60 == 59), F.transform("values", lambda x: -x)).otherwise(F.col("values")))
    return _found(s.replace(slot_values=payload), "W16", rules.payload_findings)


@query
def nonfinite_first_three(spark, d):
    rows = bind.events_tx(spark, d).rows.where("row % 271 = 31")
    return statistics.first_three(rows).select("n_bad", F.array_join(F.transform("first_three", lambda i: i.cast("string")), ",").alias("first_three"))


# more functions over columns


@query
def rows_of_part(spark, d):
    s = bind.events_tx(spark, d)
    split = splits.grouped_split(s, {"train": 0.7, "validation": 0.1, "test": 0.2}, seed=7)
    return splits.rows_of_part(s, split, "test").select("row")


@query
def legal_names(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, F.replace("p_type", F.lit(" "), F.lit("_"))).otherwise(F.col("p_type"))
    named = bind.table(spark, d, "part").select(F.concat(F.when(F.col("p_size") % 4 == 0, names.RESERVED).otherwise(""), kind).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n")).select("name", names.legal_name(F.col("name")).alias("legal"), names.reserved_name(F.col("name")).alias("reserved"), "n")


@query
def dimension_names(spark, d):
    key = F.col("c_custkey")
    logical = F.when(key % 4 == 0, F.concat(F.lit("group:"), "c_mktsegment")).when(key % 4 == 1, F.concat(F.lit("draw_"), (key % 9).cast("string"))).when(key % 4 == 2, F.concat(F.lit("component_"), (key % 5).cast("string"))).otherwise(F.col("c_mktsegment"))
    stored = bind.table(spark, d, "customer").select(names.stored_dimension(logical).alias("stored"))
    return stored.groupBy("stored").agg(F.count("*").alias("n")).select("stored", names.logical_dimension(F.col("stored")).alias("logical"), "n")


@query
def source_kinds(spark, d):
    key = F.col("o_orderkey")
    source = F.when(key % 4 == 0, "data").when(key % 4 == 1, F.concat(F.lit("callable:m"), (key % 7).cast("string"))).when(key % 4 == 2, "callable:").otherwise("file")
    counted = bind.table(spark, d, "orders").select(source.alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return counted.withColumn("p", names.source_parts(F.col("source"))).select("source", "p.kind", "p.id", "n")


@query
def utc_stamps(spark, d):
    kind = F.col("event_id") % 6
    day = F.date_format("ts", "yyyy-MM-dd")
    text = F.when(kind == 0, F.concat(day, F.date_format("ts", "'T'HH:mm:ss'Z'"))).when(kind == 1, F.concat(day, F.lit("T00:00:00.5+00:00"))).when(kind == 2, day).when(kind == 3, F.concat(day, F.lit("T25:00Z"))).when(kind == 4, F.concat(day, F.lit("T10:00+01:00"))).otherwise(F.concat(F.substring(day, 1, 4), F.lit("-02-31T10:00Z")))
    told = bind.table(spark, d, "events").select(kind.alias("kind"), names.utc_stamp(text).alias("utc"))
    return told.groupBy("kind").agg(F.count_if("utc").alias("n_utc"), F.count("*").alias("n"))


@query
def exact_texts(spark, d):
    return bind.table(spark, d, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("row"), names.text_17e(F.col("l_extendedprice")).alias("text"))


@query
def cell_measure_kinds(spark, d):
    quads, points = bind.part_mesh(spark, d)
    parts = bind.table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") * 0.01).alias("z"))
    lifted = points.drop("z").join(parts.hint("merge"), "node").select("node", "x", "y", "z")
    cells = None
    for code, corners in ((3, 2), (5, 3), (10, 4)):
        kind = quads.select((F.col("cell") * 16 + code).alias("cell"), F.lit(code).cast("smallint").alias("cell_type"), F.slice("nodes", 1, corners).alias("nodes"))
        cells = kind if cells is None else cells.unionByName(kind)
    met = geometry.corner_points(cells, lifted)
    measure = geometry.cell_measure(F.col("pts"), F.col("cell_type"))
    return met.select(F.expr("cell DIV 16").alias("cell"), F.col("cell_type").cast("int").alias("cell_type"), F.round(measure, 9).alias("measure"))


@query
def support_digest(spark, d):
    cells, points = bind.part_mesh(spark, d)
    made = cells.select(F.lit("mesh").alias("support"), "cell", "cell_type", "nodes")
    manifest = Manifest(created=bind.CREATED, supports=[Support("mesh", "mesh", points.count(), cells.count())])
    s = Study(manifest, empty(spark, "row bigint"), empty(spark, SLOT_VALUES), made, empty(spark, CATEGORIES))
    return spark.createDataFrame(list(support_ids(s).items()), "support string, digest string")
