import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import hashing, names, units
from fieldloom.functions.numbers import finite, seconds
from fieldloom.operators import codec
from fieldloom.sources.study import StudyError, chunk_rows


@pytest.mark.parametrize("text,expected", [("W m-2", {"kg": 1, "s": -3}), ("kg/(m s)", {"kg": 1, "m": -1, "s": -1}), ("1", {}), ("m/s^2", {"m": 1, "s": -2}), ("(m s)-2", {"m": -2, "s": -2}), ("kilometre", {"m": 1}), ("m per s", {"m": 1, "s": -1}), ("1e3 m", {"m": 1}), ("%", {}), ("m**2", {"m": 2})])
def test_units_parse(text, expected):
    assert units.dimensions(text) == expected


@pytest.mark.parametrize("text", ["kg/(m s", "fortnight", "", "m//s", "/s", "m)", None, "(" * 40 + "m" + ")" * 40, "m " * 5000])
def test_units_refused(text):
    assert units.dimensions(text) is None


def test_units_combine():
    assert units.same_dimensions("Pa", "N m-2") and not units.same_dimensions("furlong", "furlong")
    assert units.power("m", 2) == "m2" and units.power("m s", 2) == "(m s)^2" and units.product("Pa", "m2") == "Pa m2"
    assert units.product("1", "m2") == "m2"


def test_draws_and_digests():
    assert [f"{x:016x}" for x in hashing.nth_draw(np.arange(5), 0)] == ["e220a8397b1dcdaf", "6e789e6aa1b965f4", "06c45d188009454f", "f88bb8a8724c81ec", "1b39896a51a8749b"]
    assert hashing.support_digest("mesh", 6, [9, 9], [[0, 1, 4, 3], [1, 2, 5, 4]]) == "96df395d80ef548444562292de441525ba0b5c8ad00a8dadff19a19c943936c7"
    assert hashing.support_digest("axis", 4, coordinates=[0, 0.5, 1, 1.5]) == "57467fe7370808bdb0ad01b95d963f59e8bc6762f90f96049453ae33bb05a54c"
    assert hashing.support_digest("none", 0) == "af5570f5a1810b7af78caf4bc70a660f0df51e42baf91d4de5b2328de0e83dfc"


def test_codec_round_trip():
    state = {"a": 1, "b": 1.0, "c": True, "d": "é", "e": None, "f": [1, 2], "g": ["x", "y"], "h": [], "i": {"type": "inner"}, "j": np.array([[1.5, 2.5]]), "k": np.array(3), "l": [[1, 2], [3, 4]]}
    back = codec.decode(codec.encode(state))
    assert isinstance(back["a"], int) and isinstance(back["b"], float) and back["c"] is True and back["e"] is None
    assert back["h"].dtype == np.float64 and back["h"].shape == (0,) and back["j"].tolist() == [[1.5, 2.5]] and back["k"] == 3 and back["l"].shape == (2, 2)
    assert codec.encode({k: v for k, v in back.items()}) == codec.encode(state)


@pytest.mark.parametrize("state", [{"type": 1}, {"x": [1, "a"]}, {"x": [[1], [1, 2]]}, {"x": [{}]}, {"x": [None]}, {"x": np.float32([1])}, {"x": "a\0b"}, {"fieldloom_x": 1}, {"x": 1 << 70}])
def test_codec_refuses(state):
    with pytest.raises(StudyError, match="E32"):
        codec.encode(state)


def test_names(spark):
    assert names.is_legal("a.b+c-1") and not names.is_legal("a b") and not names.is_legal("fieldloom_x")
    assert names.reference_parts("row=3") == ("row", "3", None) and names.reference_parts("group:m=w a") == ("group", "w a", "m")
    assert names.varies_group("group:k") == "k" and names.varies_group("row") is None
    with pytest.raises(ValueError):
        names.varies_group("rows")
    row = spark.range(1).select(names.stored_dimension(F.lit("group:k")).alias("a"), names.logical_dimension(F.lit("group_k")).alias("b"), names.logical_dimension(F.lit("draw_3")).alias("c"), names.path_parts(F.lit("s0/node_arrays/p")).alias("d"), names.source_parts(F.lit("callable:m1")).alias("e"), names.source_parts(F.lit("model")).alias("f"), names.utc_stamp(F.lit("2026-09-19T10:00:00Z")).alias("g"), names.utc_stamp(F.lit("19/09/2026")).alias("h"), names.text_17e(F.lit(2.5)).alias("i")).first()
    assert (row.a, row.b, row.c, row.d.name, row.e.id, row.f.kind, row.g, row.h, row.i) == ("group_k", "group:k", "draw", "p", "m1", None, True, False, "2.50000000000000000e+00")


def test_numbers(spark):
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in frame.select(finite(F.col("v"))).collect()] == [True, False, False, False]
    assert spark.sql("SELECT timestamp_ntz'1970-01-02 00:00:00.5' AS t").select(seconds(F.col("t"))).first()[0] == 86400.5


def test_chunk_rows():
    assert chunk_rows(8, 10) == 10 and chunk_rows(1 << 19, 10) == 2 and chunk_rows(1 << 22, 10) == 1 and chunk_rows(8, 0) == 1
