"""Places and running sums over blocks, against plain Python."""

import random

from pyspark.sql import functions as F

from fieldloom.operators import ordering
from fieldloom.plans import rules


def test_running_sum_crosses_blocks_and_keeps_groups_apart(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 10)
    draw = random.Random(3)
    data = [(k % 3 if k % 7 else None, k * 3 - 40, draw.choice([None, 0, 1, 5])) for k in range(120)]
    frame = spark.createDataFrame(data, "g int, at bigint, w int").repartition(5)
    for within in ((), ("g",)):
        seen: dict = {}
        want = {}
        for g, at, w in sorted(data, key=lambda r: r[1]):
            key = g if within else 0
            seen[key] = seen.get(key, 0) + (w or 0)
            want[at] = seen[key]
        got = ordering.running_sum(frame, ["at"], F.col("w"), "s", within=within)
        assert got.columns == ["g", "at", "w", "s"]
        assert {r["at"]: r.s for r in got.collect()} == want
        places = sorted(r.n for r in ordering.numbered(frame, ["at"], "n", within=within).where("g = 1 OR g IS NULL" if not within else "g = 1").collect())
        assert places == (list(range(len(places))) if within else sorted(i for i, r in enumerate(sorted(data, key=lambda r: r[1])) if r[0] in (1, None)))


def test_numbered_by_text_and_nothing(spark):
    names = [f"u{n}" for n in random.Random(4).sample(range(10_000), 500)]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    ranges = ordering.in_ranges(frame.repartition(7), ["name"], "__range")
    got = {r.name: r.n for r in ordering.numbered(ranges, ["name"], "n", F.col("__range")).collect()}
    assert got == {name: i for i, name in enumerate(sorted(names))}
    assert ordering.numbered(frame.limit(0).withColumn("at", F.lit(1)), ["at"], "n").count() == 0


def test_ties_and_nulls_each_take_one_place(spark):
    frame = spark.createDataFrame([(None,), (None,), (5,), (5,), (1,)], "at bigint")
    got = sorted((r["at"] is not None, r["at"] or 0, r.n) for r in ordering.numbered(frame, ["at"], "n").collect())
    assert got == [(False, 0, 0), (False, 0, 1), (True, 1, 2), (True, 5, 3), (True, 5, 4)]


def test_offsets_are_checked_across_block_borders(spark, monkeypatch):
    monkeypatch.setattr(rules, "BLOCK", 4)
    good = [(i, 2 * i) for i in range(11)]
    frame = lambda rows: spark.createDataFrame(rows, "at bigint, offset bigint").repartition(3)
    assert rules.check_offsets(frame(good), 20).count() == 0
    bad = [(i, o - 9 if i == 8 else o + (i == 0)) for i, o in good]
    assert sorted(r["at"] for r in rules.check_offsets(frame(bad), 21).collect()) == [0, 8, 10]
