import pytest
from fixtures import affine, two_plates

from fieldloom import cli
from fieldloom.operators.wide import wide_table
from fieldloom.sources import limits
from fieldloom.sources.study import StudyError, write_study


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "study")
    write_study(two_plates(spark), path)
    return path


def test_verbs(spark, stored):
    assert cli.run(spark, ["validate", stored]) == ("0 error(s), 0 warning(s)", 0)
    assert "key throttle condition [1]" in cli.run(spark, ["info", stored])[0]
    assert cli.run(spark, ["support-id", stored])[0].startswith("s0 96df395d")
    assert "63.25" in cli.run(spark, ["probe", stored, "stress", "--at", "row=1", "node=3", "component=0"])[0]
    assert len(cli.run(spark, ["rows", stored, "stress", "0", "1"])[0].splitlines()) == 7
    assert "12.25" in cli.run(spark, ["stats", stored, "stress"])[0]


def test_evaluate_reads_csv(spark, tmp_path):
    write_study(affine(spark), str(tmp_path / "model"))
    (tmp_path / "keys.csv").write_text("mach,alpha\n0.5,4.0\n")
    assert "1.45" in cli.run(spark, ["evaluate", str(tmp_path / "model"), str(tmp_path / "keys.csv"), "--slot", "cl"])[0]
    assert '"t":"dict"' in cli.run(spark, ["dict-dump", str(tmp_path / "model"), "m1"])[0]


def test_wide_table_and_limits(spark):
    study = two_plates(spark)
    wide = wide_table(study)
    assert wide.columns == ["row", "throttle", "plate", "gain", *(f"stress_{i}" for i in range(6))]
    assert wide.where("row = 1").first().stress_3 == 63.25
    assert limits.elements(study.payload(study.manifest.find("stress")).select("values")) == 12
    with pytest.raises(StudyError):
        limits.collect_within(study.payload(study.manifest.find("stress")), 5)
