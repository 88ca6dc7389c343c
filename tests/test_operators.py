import dataclasses
import math
import re

import pytest
from fixtures import MESH6_ID, affine, draws, rotors, two_plates, two_runs, two_supports
from pyspark.sql import functions as F

from fieldloom.operators import access, geometry, joins, models, mutate, splits, statistics, supports, trajectory
from fieldloom.operators.integrate import integrate
from fieldloom.sources.manifest import Slot
from fieldloom.sources import study as study_module
from fieldloom.sources.study import StudyBuilder, StudyError, open_study, write_study


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def test_probe_and_range(spark):
    s = two_plates(spark)
    assert access.at(s, s.manifest.find("stress"), row=1, node=3, component=0).first().value == 63.25
    assert access.at(s, s.manifest.find("coordinates"), instance=1, node=4, component=0).first().value == 5.0
    assert [r.value for r in s.long(s.manifest.find("stress"), 1, 2).orderBy("site").collect()] == [57.25, 59.25, 61.25, 63.25, 65.25, 67.25]
    assert s.manifest.support("s0").support_id == MESH6_ID == supports.digest_of(s, "s0")
    with pytest.raises(KeyError):
        s.manifest.find("nothing")


def test_transpose_and_permute(spark):
    s = two_plates(spark)
    slot = s.manifest.find("s0/coordinates")
    got = access.transpose(s, slot, "component", "node", "instance").collect()
    assert [r.value for r in got[6:10]] == [0.0, 3.0, 2.0, 5.0]
    assert access.permute(s, s.manifest.find("s0/zone"), "draw", "cell").count() == 2
    with pytest.raises(StudyError):
        access.permute(s, slot, "node", "component")


def test_statistics_by_label(spark):
    s = two_runs(spark)
    got = rows(statistics.field_statistics(s, s.manifest.find("heat"), by="side").where("row = 0").select("side", "count", "min", "max", "mean", "std"), "side")
    assert [r[:5] for r in got] == [("lower", 3, 0.0, 4.0, 2.0), ("upper", 3, 6.0, 10.0, 8.0)]
    assert all(abs(r[5] - math.sqrt(8 / 3)) < 1e-12 for r in got)
    plain = statistics.field_statistics(s, s.manifest.find("heat")).orderBy("row").first()
    assert (plain["count"], plain["mean"]) == (6, 5.0) and abs(plain["std"] - math.sqrt(35 / 3)) < 1e-12


def test_missing_values(spark):
    b = StudyBuilder(spark, n_rows=2)
    b.add_support("s", "axis", 3, None, [[0.0, 1.0, 3.0]], "m")
    nan = float("nan")
    b.add_array("s", "node", "v", [[1.0, nan, 3.0], [nan, nan, nan]], units="1")
    s = geometry.with_weights(b.build(), "s")
    got = statistics.field_statistics(s, s.manifest.find("v")).orderBy("row").collect()
    assert (got[0]["count"], got[0]["n_missing"], got[0]["mean"], got[0]["std"]) == (2, 1, 2.0, 1.0)
    assert got[1]["count"] == 0 and all(math.isnan(got[1][c]) for c in ("min", "max", "mean", "std"))
    total = integrate(s, s.manifest.find("v")).orderBy("row").collect()
    assert [(r.integral, r.n_missing) for r in total] == [(0.5 + 3.0, 1), (0.0, 3)]


def test_draw_summaries(spark):
    s = draws(spark)
    got = {(r.instance, r.site): r for r in statistics.draw_summaries(s, s.manifest.find("stress"), 0.9).collect()}
    assert got[1, 3]["mean"] == 16.5 and abs(got[0, 0]["std"] - 3.5) < 1e-12 and abs(got[0, 2]["quantile"] - 9.5) < 1e-9
    with pytest.raises(StudyError):
        statistics.field_statistics(s, s.manifest.find("stress"))


def test_integrals(spark):
    s = two_runs(spark)
    heat = s.manifest.find("heat")
    assert [r.integral for r in integrate(s, heat).orderBy("row").collect()] == [7.5, 13.5, 19.5, 25.5, 31.5, 37.5]
    assert [r.integral for r in integrate(s, heat, by="side", region="lower").orderBy("row").collect()] == [1.5, 4.5, 7.5, 10.5, 13.5, 16.5]


def test_weights(spark):
    s = two_runs(spark)
    assert [r.weight for r in geometry.computed_weights(s, "s0").orderBy("site").collect()] == [1.5, 3.0, 1.5, 1.5, 3.0, 1.5]
    axis = spark.createDataFrame([(0, i, x) for i, x in enumerate([0.0, 1.0, 2.0, 5.0])], "instance int, node int, x double")
    assert [r.weight for r in geometry.axis_weights(axis).orderBy("node").collect()] == [0.5, 1.0, 2.0, 1.5]
    again = geometry.with_weights(s, "s0")
    assert [x.name for x in again.manifest.arrays() if x.role == "weight"] == ["weight"] and again.manifest.find("weight").units == "m2"


CUBE = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
SHAPES = {
    "line": (3, [(0, 0, 0), (3, 4, 0)], 5.0),
    "triangle": (5, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], 0.5),
    "quad": (9, [(0, 0, 1), (2, 0, 1), (2, 1, 1), (0, 1, 1)], 2.0),
    "pentagon": (7, [(0, 0, 0), (2, 0, 0), (2, 2, 0), (1, 3, 0), (0, 2, 0)], 5.0),
    "tetrahedron": (10, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], 1 / 6),
    "hexahedron": (12, CUBE, 1.0),
    "wedge": (13, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 2), (1, 0, 2), (0, 1, 2)], 1.0),
    "pyramid": (14, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 3)], 1.0),
    "vertex": (1, [(7, 7, 7)], 1.0),
}


@pytest.mark.parametrize("name", SHAPES)
def test_cell_measures(spark, name):
    code, corners, expected = SHAPES[name]
    cells = spark.createDataFrame([(0, code, list(range(len(corners))))], "cell bigint, cell_type smallint, nodes array<bigint>")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(corners)], "node bigint, x double, y double, z double")
    got = geometry.corner_points(cells, points).select(geometry.cell_measure(F.col("pts"), F.col("cell_type")).alias("m")).first().m
    assert abs(got - expected) < 1e-12


def test_quadratic_and_mixed_cells_are_refused(spark):
    for cells in ([(22, [0, 1, 2, 3, 4, 5])], [(9, [0, 1, 4, 3]), (3, [0, 1])]):
        b = StudyBuilder(spark, n_rows=1).add_support("s0", "mesh", 6, cells, [[0.0] * 12], "m", "none", 2)
        with pytest.raises(StudyError):
            geometry.cell_measures(b.build(), "s0")


def test_time_series(spark):
    s = two_runs(spark)
    assert rows(trajectory.time_series(s, s.manifest.find("heat"), trajectory=1, node=2).select("t", "v"), "t") == [(0.0, 12.0), (0.5, 16.0), (0.75, 20.0), (2.0, 24.0)]


def test_unaligned_instances(spark):
    s = two_supports(spark)
    got = rows(joins.gather(s, s.manifest.find("s1/stress")).select("row", "instance", F.col("values")[0]), "row")
    assert got == [(0, 0, 20.0), (2, 1, 40.0), (3, 2, 60.0)]
    assert rows(joins.gather(s, s.manifest.find("s0/stress")).select("row", "instance"), "row") == [(1, 0)]
    assert rows(joins.support_of_rows(s), "row") == [(0, "s1"), (1, "s0"), (2, "s1"), (3, "s1")]


def test_group_varying_instances(spark):
    s = two_plates(spark)
    assert [r["values"][6] for r in joins.gather(s, s.manifest.find("coordinates")).orderBy("row").collect()] == [0.0, 3.0]


def test_split_worked_example(spark):
    s = rotors(spark)
    units = splits.deal_units(statistics.distinct_units(s), {"train": 0.8, "test": 0.2}, 0)
    assert [(r.unit, r.part) for r in units.orderBy("draw").collect()] == [("rotor_c", "test"), ("rotor_e", "train"), ("rotor_b", "train"), ("rotor_a", "train"), ("rotor_d", "train")]
    assert rows(splits.grouped_split(s, {"train": 8, "test": 2}).where("part = 'test'"), "row") == [(0, "test")]


def test_split_sizes():
    assert splits.part_sizes(3, {"train": 0.67, "test": 0.33}) == {"test": 1, "train": 2}
    assert splits.part_sizes(2, {"a": 1.0, "b": 0.0}) == {"a": 1, "b": 1}
    for bad in ({}, {"a": -1.0, "b": 2.0}, {"a": 0.0}):
        with pytest.raises(ValueError):
            splits.part_sizes(5, bad)
    with pytest.raises(ValueError):
        splits.part_sizes(1, {"a": 1.0, "b": 1.0})


def test_affine_worked_example(spark):
    s = affine(spark)
    done = models.evaluate(s, spark.createDataFrame([(0, 0.5, 4.0)], "row bigint, mach double, alpha double"))
    row = done.rows.first()
    assert (row.cl, row.cl_band) == (1.45, 0.02)
    assert done.payload(done.manifest.find("pressure")).first()["values"] == [0.5, 1.1, 3.7, 4.3, 6.9, 7.5]
    band = done.manifest.find("pressure_band")
    assert done.payload(band).first()["values"] == [0.05, 0.1, 0.15, 0.2, 0.25, 0.3] and (band.level, band.method) == (0.68, "constant band")
    assert not done.manifest.models and done.manifest.n_rows == 1


def test_prediction(spark):
    s = affine(spark)
    keys = spark.createDataFrame([(0, 0.5, 4.0)], "row bigint, mach double, alpha double")
    got = models.prediction(s, s.manifest.find("cl"), keys).first()
    assert (got["mean"], got["uncertainty"], got["level"]) == ([1.45], [0.02], 0.95)
    with pytest.raises(StudyError):
        models.prediction(s, s.manifest.find("cl_band"), keys)
    with pytest.raises(StudyError):
        models.prediction(two_plates(spark), two_plates(spark).manifest.find("gain"), keys)
    with pytest.raises(StudyError, match="E39"):
        models.evaluate(s, spark.createDataFrame([(0, 0.5)], "row bigint, mach double"))


def test_unregistered_model_is_kept_but_does_not_run(spark):
    kept = models.load("other", {"x": 1})
    assert kept.to_dict() == {"x": 1} and kept.type == "other" and "affine" in models.registered_types()
    with pytest.raises(StudyError):
        kept.outputs(None)


def _ids(spark, values, offset=0):
    b = StudyBuilder(spark, n_rows=len(values))
    b.add_category_table("kind", ["a", "b"] if offset == 0 else ["b", "a"])
    b.add_key("id", [i for i, _, _ in values], "id")
    b.add_key("kind", [k for _, k, _ in values], "categorical", category="kind")
    b.add_scalar("v", [v for _, _, v in values], "1")
    return b.build()


def test_append_and_replace(spark):
    own = _ids(spark, [(10, 0, 1.0), (20, 1, 2.0)])
    batch = _ids(spark, [(30, 0, 3.0), (20, 1, 9.0)], offset=1)
    plain = mutate.append_rows(own, batch)
    assert rows(plain.rows.select("row", "id", "kind", "v"), "row") == [(0, 10, 0, 1.0), (1, 20, 1, 2.0), (2, 30, 1, 3.0), (3, 20, 0, 9.0)]
    merged = mutate.append_rows(own, batch, replace_by="id")
    assert rows(merged.rows.select("row", "id", "kind", "v"), "row") == [(0, 10, 0, 1.0), (1, 20, 0, 9.0), (2, 30, 1, 3.0)] and merged.manifest.n_rows == 3
    with pytest.raises(StudyError):
        mutate.append_rows(own, _ids(spark, [(30, 0, 3.0), (30, 1, 9.0)]), replace_by="id")
    with pytest.raises(StudyError):
        mutate.append_rows(own, batch, replace_by="kind")


def test_structural_difference(spark):
    a, b = two_plates(spark), two_plates(spark)
    assert mutate.structurally_equal(a, b)
    nan = b.replace(rows=b.rows.withColumn("gain", F.when(F.col("row") == 1, F.lit(float("nan"))).otherwise(F.col("gain"))))
    assert rows(mutate.structural_difference(a, nan), "path") == [("rows", "differs", 1)]
    assert mutate.structurally_equal(nan, nan)


def test_write_open_round_trip(spark, tmp_path):
    s = two_plates(spark)
    path = str(tmp_path / "study")
    write_study(s, path)
    back = open_study(spark, path)
    assert mutate.structurally_equal(s, back) and back.row_count() == 2
    broken = s.with_manifest(writer=None)
    with pytest.raises(StudyError, match="E17"):
        write_study(broken, path)
    assert mutate.structurally_equal(s, open_study(spark, path))
    write_study(s.with_manifest(notes={"a": "b"}), path)
    assert open_study(spark, path).manifest.notes == {"a": "b"}


def test_builder_refuses(spark):
    b = StudyBuilder(spark, n_rows=2)
    for rule, call in [("E33", lambda: b.add_key("a b", [1.0, 2.0], "design", units="1")), ("E39", lambda: b.add_key("m", [1.0, 2.0], "design")), ("E16", lambda: b.add_scalar("c", [1.0], "1")), ("E02", lambda: b.add_key("m", [1, 2], "other")), ("E38", lambda: b.add_support("s", "mesh", 3))]:
        with pytest.raises(StudyError, match=rule):
            call()
    b.add_support("s0", "mesh", 6, [(9, [0, 1, 4, 3])], [[0.0] * 12], "m", "none", 2)
    with pytest.raises(StudyError, match="E05"):
        b.add_array("s0", "node", "p", [[1.0]], units="Pa")
    with pytest.raises(StudyError, match="E04"):
        b.add_array("s0", "node", "p", [[1.0] * 6], units="Pa", varies="group:none")


def test_bounds_and_categories(spark):
    frame = spark.createDataFrame([(0, "b", 1.0), (1, "a", 5.0), (2, "b", float("nan"))], "row bigint, kind string, x double")
    b = StudyBuilder(spark, frame).add_category_table("kind", "kind").encode("kind", "kind")
    b.add_key("kind", "kind", "categorical", category="kind").add_key("x", "x", "design", units="m")
    s = b.build()
    assert (s.manifest.key("x").lower, s.manifest.key("x").upper) == (1.0, 5.0)
    assert rows(s.rows.select("row", "kind"), "row") == [(0, 1), (1, 0), (2, 1)]


def test_derived_difference(spark):
    s = two_plates(spark)
    got = mutate.derived_difference(s.payload(s.manifest.find("coordinates")).select("instance", "values"), 0)
    assert got.where("instance = 1").first()["values"][6:8] == [3.0, 0.0]


def test_shared_supports_and_bounds(spark):
    assert ("s0", "s0") in joins.shared_supports(two_plates(spark), two_supports(spark))
    met = joins.bounds_intersection(spark.createDataFrame([("a", "x", 0.0, 2.0), ("b", "x", 1.0, 3.0), ("a", "y", 0.0, 1.0), ("b", "y", 2.0, 3.0)], "model string, key string, lower double, upper double"))
    assert rows(met, "key") == [("x", 1.0, 2.0, False), ("y", 2.0, 1.0, True)]


def test_interval_of_stored_band(spark):
    s = two_plates(spark)
    band = Slot("gain_band", "row", units="1", statistic="band", of="gain", level=0.95, method="half")
    s = s.replace(rows=s.rows.withColumn("gain_band", F.lit(0.5)), manifest=dataclasses.replace(s.manifest, slots=[*s.manifest.slots, band]))
    got = models.interval(models.prediction(s, s.manifest.find("gain"))).orderBy("row").first()
    assert (got["mean"], got["lower"], got["upper"]) == (1.5, 1.0, 2.0)


def test_a_failed_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "study")
    s = two_plates(spark)
    with pytest.raises(StudyError):
        open_study(spark, path)
    write_study(s.with_manifest(notes={"n": "1"}), path)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(study_module, "_publish", fail)
        with pytest.raises(OSError):
            write_study(s.with_manifest(notes={"n": "2"}), path)
    assert open_study(spark, path).manifest.notes["n"] == "1"
    write_study(s.with_manifest(notes={"n": "3"}), path)
    assert open_study(spark, path).manifest.notes["n"] == "3"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_few_categories_are_broadcast(spark):
    from fieldloom.plans import bind

    many = spark.range(3_000_000).select(F.col("id").alias("row"), F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("flag"))
    table = joins.category_table(many, "flag", "flag")
    assert rows(table, "id") == [("flag", 0, "f0"), ("flag", 1, "f1"), ("flag", 2, "f2")]
    assert "BroadcastHashJoin" in (plan := plan_of(bind._coded(many, "flag", table, "code"))) and "SortMergeJoin" not in plan


def test_listed_entries_are_broadcast(spark):
    from fieldloom.plans import bind

    entries = bind._entries(spark, "status", ["converged", "failed"])
    assert rows(entries, "id") == [("status", 0, "converged"), ("status", 1, "failed")] and [t for _, t in entries.dtypes] == ["string", "int", "string"]
    many = spark.range(3_000_000).select((F.col("id") % 2).cast("int").alias("status"))
    assert "SortMergeJoin" not in plan_of(joins.decode_category(many, "status", entries, "name"))


def test_used_entries_meet_once(spark):
    many = spark.range(3_000_000).select((F.col("id") % 2).cast("int").alias("k"))
    unused = joins.unused_categories(many, "k", spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id int, entry string"))
    assert "HashAggregate(keys=[__used" in plan_of(unused) and [r.id for r in unused.collect()] == [2]


def test_corners_are_dealt_by_the_count_of_cells(spark, monkeypatch):
    monkeypatch.setattr(geometry, "CELLS", 10)
    points = spark.range(102).select(F.col("id").alias("node"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    cells = spark.range(100).coalesce(1).select(F.col("id").alias("cell"), F.lit(3).cast("smallint").alias("cell_type"), F.array("id", F.col("id") + 2).alias("nodes"))
    met = geometry.corner_points(cells, points)
    assert re.search(r"hashpartitioning\(cell#\d+L, 10\)", plan := plan_of(met)) and "BroadcastHashJoin" not in plan
    assert {(r.m, r.n) for r in met.groupBy(geometry.cell_measure(F.col("pts"), F.col("cell_type")).alias("m")).agg(F.count("*").alias("n")).collect()} == {(2.0, 100)}
