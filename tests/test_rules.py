"""Each rule fires on its fault, and on nothing else."""

import dataclasses

import pytest
from fixtures import affine, two_plates, two_runs, two_supports
from pyspark.sql import functions as F

from fieldloom.plans import rules
from fieldloom.sources.manifest import Key, Model, Slot


def ids(study):
    errors, warnings = rules.report_ids(rules.findings(study))
    return [*errors, *warnings]


def with_key(study, name, **changes):
    return study.with_manifest(keys=[dataclasses.replace(k, **changes) if k.name == name else k for k in study.manifest.keys])


def with_slot(study, name, **changes):
    return study.with_manifest(slots=[dataclasses.replace(s, **changes) if s.name == name else s for s in study.manifest.slots])


def plus_slot(study, slot):
    return study.with_manifest(slots=[*study.manifest.slots, slot])


def with_support(study, name, **changes):
    return study.with_manifest(supports=[dataclasses.replace(s, **changes) if s.name == name else s for s in study.manifest.supports])


def set_row(study, column, row, value):
    return study.replace(rows=study.rows.withColumn(column, F.when(F.col("row") == row, F.lit(value)).otherwise(F.col(column))))


def set_values(study, slot, f, instance=0):
    here = (F.col("slot") == slot) & (F.col("instance") == instance)
    return study.replace(slot_values=study.slot_values.withColumn("values", F.when(here, f(F.col("values"))).otherwise(F.col("values"))))


# faults of the declarations alone: (fault, ids that the manifest rules report)
DECLARED = {
    "format": (lambda s: s.with_manifest(format="fieldloom/9"), ["E01"]),
    "role": (lambda s: with_key(s, "throttle", role=None), ["E02"]),
    "no unit group": (lambda s: s.with_manifest(generalisation_group=None), ["E39"]),
    "unit only in private": (lambda s: s.with_manifest(generalisation_group=None, private={"unit": "x"}), ["E18", "E39"]),
    "unknown group": (lambda s: with_slot(s, "coordinates", varies="group:x"), ["E04"]),
    "units of a field": (lambda s: with_slot(s, "stress", units=None), ["E11"]),
    "statistic without of": (lambda s: with_slot(s, "stress", statistic="mean"), ["E12"]),
    "band without level": (lambda s: plus_slot(s, Slot("b", "row", units="1", statistic="band", of="gain", method="m")), ["E12"]),
    "derived without recipe": (lambda s: with_slot(s, "stress", role="derived"), ["E13"]),
    "missing model": (lambda s: with_slot(s, "stress", source="callable:m9", output="p"), ["E14"]),
    "model without type": (lambda s: s.with_manifest(models=[Model("m", None)]), ["E15"]),
    "writer": (lambda s: s.with_manifest(writer=None), ["E17"]),
    "bound not finite": (lambda s: with_key(s, "throttle", upper=float("inf")), ["E19"]),
    "components": (lambda s: with_slot(s, "stress", components=None), ["E31"]),
    "dictionary": (lambda s: s.with_manifest(models=[Model("m", "affine", "{")]), ["E32"]),
    "reserved name": (lambda s: s.with_manifest(keys=[Key("fieldloom_x", "condition", units="1"), *s.manifest.keys[1:]]), ["E33"]),
    "source": (lambda s: with_slot(s, "stress", source="model"), ["E36"]),
    "aligned": (lambda s: s.with_manifest(aligned=False), ["E37"]),
    "mesh without cells": (lambda s: with_support(s, "s0", n_cells=0), ["E38"]),
    "key without units": (lambda s: with_key(s, "throttle", units=None), ["E39"]),
    "weight not recomputed": (lambda s: plus_slot(s, Slot("w", "node", "s0", "weight", "m2", "none")), ["W06"]),
    "units": (lambda s: with_key(s, "throttle", units="kg/(m s"), ["W10"]),
    "unknown attribute": (lambda s: s.with_manifest(extra={"x": "1"}), ["W11"]),
    "created": (lambda s: s.with_manifest(created="19/09/2026"), ["W14"]),
    "two times": (lambda s: s.with_manifest(keys=[*s.manifest.keys, *(Key(n, "time", units="s", trajectory_group="plate") for n in "tu")]), ["E03"]),
    "two coordinates": (lambda s: plus_slot(s, Slot("c2", "node", "s0", "coordinates", "m", "none", 2)), ["E03"]),
}


@pytest.fixture(scope="module")
def base(spark):
    study = two_plates(spark)
    return study.replace(rows=study.rows.cache(), slot_values=study.slot_values.cache(), cells=study.cells.cache(), categories=study.categories.cache())


@pytest.mark.parametrize("name", DECLARED)
def test_declared_faults(base, name):
    fault, expected = DECLARED[name]
    errors, warnings = rules.report_ids(rules.manifest_findings(fault(base).manifest))
    assert [*errors, *warnings] == expected


def test_axis_that_varies(spark):
    from fieldloom.plans import bind

    m = bind.Manifest(created=bind.CREATED, keys=[Key("g", "group", category="g")], generalisation_group="g", slots=[Slot("x", "node", "a", "coordinates", "m", "row")], supports=[bind.Support("a", "axis", 4)])
    assert [f.rule for f in rules.manifest_findings(m)] == ["E35"]


STORED = {
    "nothing": (lambda s: s, []),
    "five nodes": (lambda s: set_values(s, "stress", lambda v: F.slice(v, 1, 5)), ["E05"]),
    "digest": (lambda s: with_support(s, "s0", support_id="0" * 64), ["E08"]),
    "unknown category": (lambda s: set_row(s, "plate", 1, 2), ["E10", "W07"]),
    "row count": (lambda s: s.with_manifest(n_rows=3), ["E16"]),
    "float key": (lambda s: s.replace(rows=s.rows.withColumn("throttle", F.col("throttle").cast("float"))), ["E20"]),
    "cell type": (lambda s: s.replace(cells=s.cells.withColumn("cell_type", F.when(F.col("cell") == 1, 99).otherwise(9).cast("smallint"))), ["E08", "E21"]),
    "node count": (lambda s: s.replace(cells=s.cells.withColumn("cell_type", F.when(F.col("cell") == 1, 5).otherwise(9).cast("smallint"))), ["E08", "E22"]),
    "node": (lambda s: s.replace(cells=s.cells.withColumn("nodes", F.transform("nodes", lambda n: F.when(n == 5, 6).otherwise(n)))), ["E08", "E24"]),
    "entry": (lambda s: s.replace(categories=s.categories.withColumn("entry", F.when(F.col("entry") == "hot", F.lit("h\0t")).otherwise(F.col("entry")))), ["E26"]),
    "no data": (lambda s: s.replace(slot_values=s.slot_values.where("slot <> 'stress'")), ["E30"]),
    "components": (lambda s: with_slot(s, "stress", components=2), ["E31"]),
    "instances": (lambda s: s.replace(slot_values=s.slot_values.where("slot <> 'coordinates' OR instance = 0")), ["E34"]),
    "not finite": (lambda s: set_row(s, "gain", 1, float("nan")), ["W03"]),
    "field not finite": (lambda s: set_values(s, "stress", lambda v: F.transform(v, lambda x: F.lit(float("inf")))), ["W03"]),
    "outside": (lambda s: set_row(s, "throttle", 1, 1.2), ["W04"]),
    "stale": (lambda s: with_key(s, "throttle", lower=-1000.0, upper=1000.0), ["W08"]),
    "unused": (lambda s: set_row(s, "plate", 1, 0), ["W07"]),
}


@pytest.mark.parametrize("name", STORED)
def test_stored_faults(base, name):
    fault, expected = STORED[name]
    assert ids(fault(base)) == expected


def test_time_that_does_not_grow(spark):
    study = two_runs(spark)
    assert ids(study) == []
    assert ids(set_row(study, "t", 1, 1.0)) == ["E09"] and "E09" in ids(set_row(study, "t", 1, float("nan")))


def test_row_supports(spark):
    study = two_supports(spark)
    assert ids(study) == ["W05"]
    assert "E06" in ids(set_row(study, "support_ix", 1, 2))
    assert ids(study.replace(rows=study.rows.drop("support_ix")))[0] == "E16" or "E28" in ids(study.replace(rows=study.rows.drop("support_ix")))
    one = study.replace(rows=study.rows.withColumn("support_ix", F.lit(0)))
    assert "W15" in ids(one)


def test_served_slots(spark):
    study = affine(spark)
    assert ids(study) == []
    assert ids(with_slot(study, "cl", statistic="draw")) == ["E12"]


def test_statuses_and_leaks(spark):
    from fieldloom.sources.study import StudyBuilder

    b = StudyBuilder(spark, n_rows=4)
    b.add_category_table("member", ["a", "b"]).add_category_table("part", ["test", "train"]).add_category_table("status", ["converged", "failed"])
    b.add_key("member", [0, 0, 1, 1], "group", category="member").set_generalisation_group("member")
    b.add_key("split", [0, 1, 0, 1], "split", category="part").add_key("status", [0, 1, 0, 0], "status", category="status")
    found = {f.rule: f for f in rules.findings(b.build())}
    assert sorted(found) == ["W01", "W02"] and found["W02"].first_three == (1,) and found["W01"].count == 2


def test_report(base):
    found = rules.findings(set_row(base, "gain", 1, float("nan")))
    assert rules.report_text(found) == "W03 scalars/gain: not finite (1: 1)\n0 error(s), 1 warning(s)"
    assert rules.validate(base).count() == 0 and "rows 2" in rules.info_lines(base)
