import json

import pytest

from tickloom.sources import json_log

SCHEMA = "run_number bigint, ticker string, notes string, metrics struct<auc:double>, names array<string>"
ODD = 'a "quoted" {brace} [bracket] \\ back, "runs": ['
RUNS = [{"run_number": k, "ticker": "AB", "notes": ODD * (k % 4), "metrics": {"auc": k / 100}, "names": ["x}", "]y"] * (k % 3)} for k in range(300)]


def read(spark, path):
    return sorted((r.asDict(recursive=True) for r in json_log.read_runs(spark, str(path), SCHEMA).collect()), key=lambda r: r["run_number"])


@pytest.mark.parametrize("indent", [None, 0, 2, 4])
def test_documents_of_any_layout(spark, tmp_path, indent):
    path = tmp_path / "log.json"
    path.write_text(json.dumps({"metadata": {"best": {"a": [1, 2]}, "runs": 3}, "runs": RUNS, "after": {"x": [1]}}, indent=indent))
    assert read(spark, path) == RUNS


def test_many_tasks_read_one_document(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(json.dumps({"runs": RUNS, "metadata": {}}, indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        assert read(spark, path) == RUNS
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_written_documents_are_valid_and_come_back(spark, tmp_path):
    runs = spark.createDataFrame([(r["run_number"], r["ticker"], r["notes"], (r["metrics"]["auc"],), r["names"]) for r in RUNS], SCHEMA)
    json_log.write_runs(runs.repartition(3), str(tmp_path / "one"), spark.createDataFrame([(300, 0.9)], "total_runs long, best double"))
    file, = (tmp_path / "one").glob("*.txt")
    document = json.loads(file.read_text())
    assert document["metadata"] == {"total_runs": 300, "best": 0.9} and document["runs"] == RUNS
    assert read(spark, tmp_path / "one") == RUNS
    json_log.write_runs(runs.limit(0), str(tmp_path / "none"))
    assert read(spark, tmp_path / "none") == []


def test_several_documents(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"metadata": {}, "runs": RUNS[k::3]}, indent=k + 1))
    assert read(spark, tmp_path) == RUNS
