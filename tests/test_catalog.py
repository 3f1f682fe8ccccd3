"""Raw rows as tables of the catalog, split by run."""

from callharmony.sinks import land_raw_text
from callharmony.sources import recover_runs, register_raw_runs

NAME = "callharmony_test_runs"


def land(spark, base, run_id, *values, mode="append"):
    rows = spark.createDataFrame([(f'{{"v": {v}}}',) for v in values], "value string")
    land_raw_text(rows, str(base), "town", run_id, mode)


def test_runs_are_partitions(spark, tmp_path):
    land(spark, tmp_path, "01", 1, 2)
    land(spark, tmp_path, "2", 3)
    register_raw_runs(spark, NAME, str(tmp_path), "town", "v BIGINT")
    rows = spark.table(NAME)
    assert sorted(map(tuple, rows.collect())) == [(1, "01"), (2, "01"), (3, "2")]  # run ids stay text

    one = rows.where("run_id = '2'")
    assert [row["v"] for row in one.collect()] == [3]
    assert "InMemoryFileIndex(1 paths)" in one._jdf.queryExecution().executedPlan().toString()  # of two folders
    assert one.inputFiles() and all("/run_id=2/" in file for file in one.inputFiles())


def test_new_runs_and_lost_ones(spark, tmp_path):
    land(spark, tmp_path, "a", 1)
    register_raw_runs(spark, NAME, str(tmp_path), "town", "v BIGINT")
    land(spark, tmp_path, "b", 2)
    assert spark.table(NAME).count() == 1
    recover_runs(spark, NAME)
    assert spark.table(NAME).count() == 2
    (tmp_path / "data" / "town" / "run_id=a").rename(tmp_path / "elsewhere")
    recover_runs(spark, NAME)
    assert [tuple(row) for row in spark.table(NAME).collect()] == [(2, "b")]
