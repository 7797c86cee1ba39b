import json

import pytest

from evstrata.__main__ import main
from evstrata.sources.dataset import DataSet, DataSetError, parentage_id, write_dataset
from evstrata.sources.tables import split_events_view


@pytest.fixture(scope="module")
def path(spark, sf_dir, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("set") / "d")
    events = split_events_view(spark, sf_dir, 300).select("run", "subrun", "event", "entry", "file_no", "ts", "value")
    parameters = spark.createDataFrame([(1, "m1", None, None, None, "a: 1"), (2, "m0", None, None, None, "b: 2")], "id bigint, module_label string, service_type string, service_provider string, process_name string, body string")
    history = spark.createDataFrame([("h", 0, "DAQ"), ("h", 1, "RECO")], "history_id string, pos int, process string")
    write_dataset(events, where, parameters=parameters, histories=history, parents=[[1, 2], []], results=spark.range(3), metadata={"owner": "me", "event_count": "7"}, run_type="physics")
    return where


def test_round_trip(spark, sf_dir, path):
    data = DataSet.open(spark, path)
    events = split_events_view(spark, sf_dir, 300)
    assert data.level("events").count() == events.count()
    assert data.level("subruns").count() == events.select("run", "subrun").distinct().count()
    assert data.results().count() == 1 and data.sidecar("lineage") is None
    named = {(r["file_no"], r["name"]): r["value"] for r in data.sidecar("catalog_metadata").collect()}
    assert named[(0, "owner")] == "me" and named[(0, "event_count")] == "7"
    covered = data.sidecar("event_ranges").selectExpr("sum(end - begin)").first()[0]
    assert covered == events.count()


def test_unsound_data_sets(spark, path, tmp_path):
    with pytest.raises(DataSetError, match="no format"):
        DataSet.open(spark, str(tmp_path))
    spark.createDataFrame([("other", 15)], "era string, version int").write.parquet(str(tmp_path / "a/_format_"))
    with pytest.raises(DataSetError, match="era"):
        DataSet.open(spark, str(tmp_path / "a"))
    spark.createDataFrame([("evstrata", 99)], "era string, version int").write.parquet(str(tmp_path / "b/_format_"))
    with pytest.raises(DataSetError, match="version"):
        DataSet.open(spark, str(tmp_path / "b"))
    spark.createDataFrame([("evstrata", 15)], "era string, version int").write.parquet(str(tmp_path / "c/_format_"))
    with pytest.raises(DataSetError, match="index"):
        DataSet.open(spark, str(tmp_path / "c"))
    assert len(parentage_id([1])) == 64
    with pytest.raises(DataSetError):
        DataSet(spark, path).sidecar("nothing")


def test_commands(spark, path, tmp_path, capsys):
    def said(*argv):
        assert main(list(argv), spark) == 0
        return capsys.readouterr().out.splitlines()

    assert all(x.endswith(", 1 result") for x in said("count", path, "--hr"))
    assert json.loads(said("count", path)[0])["results"] == 1
    assert said("config", path, "-M") == ["m0: { b: 2 }", "m1: { a: 1 }"]
    assert said("config", path, "--filter", "m1") == ["m1: { a: 1 }"]
    assert said("info", path, "--process-history") == ["A. DAQ -> RECO"]
    assert len(said("info", path, "--range-of-validity", "compact")) <= len(said("info", path, "--range-of-validity", "full"))
    assert len(said("info", path, "--event-list")) < len(said("info", path, "--file-index"))
    assert "wrote file_index" in said("info", path, "--db-to-file", str(tmp_path / "out"))
    assert json.loads(said("metadata", path)[0])["owner"] == "me"
    assert said("sizes", path, "--fraction", "0")
    assert main(["count", str(tmp_path / "missing")], spark) == 1
