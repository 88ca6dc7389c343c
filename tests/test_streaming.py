import pytest
from fixtures import two_runs

from fieldloom.sources.study import StudyBuilder, StudyError, open_study, write_study
from fieldloom.streaming.append import append_batch, falls_back, start_append


def make(spark, rows):
    b = StudyBuilder(spark, n_rows=len(rows))
    b.add_category_table("run", ["a", "b"])
    b.add_key("run", [r for r, _, _ in rows], "group", category="run").set_generalisation_group("run")
    b.add_key("t", [t for _, t, _ in rows], "time", units="s", trajectory_group="run")
    b.add_scalar("v", [v for _, _, v in rows], "1")
    return b.build()


def test_stream_of_batches(spark, tmp_path):
    path, inbox = str(tmp_path / "study"), str(tmp_path / "inbox")
    write_study(make(spark, [(0, 0.0, 1.0), (1, 0.0, 2.0)]), path)
    spark.createDataFrame([(0, 0, 1.0, 3.0), (1, 1, 2.0, 4.0)], "row bigint, run int, t double, v double").write.parquet(inbox)

    def to_study(frame):
        return make(spark, [(r.run, r.t, r.v) for r in frame.orderBy("row").collect()])

    stream = spark.readStream.schema("row bigint, run int, t double, v double").parquet(inbox)
    query = start_append(stream, path, str(tmp_path / "state"), to_study)
    query.processAllAvailable()
    query.stop()
    back = open_study(spark, path)
    assert [(r.row, r.v) for r in back.rows.select("row", "v").orderBy("row").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
    append_batch(path, to_study)(spark.read.parquet(inbox), 0)  # delivered again
    assert open_study(spark, path).row_count() == 4


def test_time_across_batches(spark):
    study = two_runs(spark)
    late = spark.createDataFrame([(0, 0, 2.5), (1, 1, 2.25)], "row bigint, run int, t double")
    assert [r.row for r in falls_back(study, late).collect()] == [0]


def test_time_inside_a_batch(spark, tmp_path):
    path = str(tmp_path / "study")
    write_study(make(spark, [(0, 0.0, 1.0), (1, 0.0, 2.0)]), path)
    batch = spark.createDataFrame([(0, 0, 5.0, 1.0), (1, 0, 3.0, 1.0), (2, 1, 1.0, 1.0), (3, 7, 4.0, 1.0), (4, 7, 4.0, 1.0)], "row bigint, run int, t double, v double")
    assert sorted(r.row for r in falls_back(open_study(spark, path), batch).collect()) == [1, 4]

    def to_study(frame):
        return make(spark, [(r.run, r.t, r.v) for r in frame.orderBy("row").collect()])

    with pytest.raises(StudyError, match="E09"):
        append_batch(path, to_study)(batch.where("run = 0"), 0)
    assert open_study(spark, path).row_count() == 2
