"""What a run stores goes when it ends."""

import json
import pathlib
import time

import pytest

from linkrec import storage
from linkrec.plans import catalog

DIR = "/root/testdata/sf0.001"


def folder(spark):
    return pathlib.Path(storage.shared_folder(spark).removeprefix("file:")) / "linkrec"


def test_a_query_leaves_nothing_but_its_result(spark, tmp_path):
    before = set(folder(spark).glob("*"))
    with storage.temporary_tables(spark) as run:
        df = catalog.QUERIES["topk_recommendations"](spark, DIR)
        df.write.parquet(str(tmp_path / "result"))
        n = df.count()
        assert len(list((folder(spark) / run).glob("*"))) > 2
    assert set(folder(spark).glob("*")) == before
    assert spark.read.parquet(str(tmp_path / "result")).count() == n > 0


def test_a_failed_run_leaves_nothing(spark):
    before = set(folder(spark).glob("*"))
    with pytest.raises(Exception, match="division|DIVIDE"):
        with storage.temporary_tables(spark):
            table = storage.stored(spark.range(5), "some")
            storage.stored(table.selectExpr("1 / (id - 3)"), "fails")
    assert set(folder(spark).glob("*")) == before and not storage._RUNS


def test_catalog_tables_go_as_well(spark):
    kept = storage.fresh_path(spark, "kept")
    spark.range(3).write.option("path", kept).saveAsTable("linkrec_kept")
    with storage.temporary_tables(spark):
        path = storage.fresh_path(spark, "texts")
        spark.range(3).write.option("path", path).saveAsTable("linkrec_of_run")
        assert spark.table("linkrec_of_run").count() == 3
    names = {t.name for t in spark.catalog.listTables(pattern="linkrec_*")}
    assert "linkrec_of_run" not in names and "linkrec_kept" in names
    spark.sql("DROP TABLE linkrec_kept")


def test_runs_may_be_nested(spark):
    with storage.temporary_tables(spark):
        outer = storage.stored(spark.range(4), "outer")
        with storage.temporary_tables(spark):
            storage.stored(outer, "inner")
        assert storage.stored(outer, "again").count() == 4


def test_sweep_removes_runs_of_lost_drivers(spark):
    def manifest(run, application, hours):
        place = folder(spark) / run
        place.mkdir(parents=True)
        told = {"application": application, "started": time.time() - hours * 3600}
        (place / storage.MANIFEST).write_text(json.dumps(told))
        return place

    old = manifest("run-old", "another", 60)
    new = manifest("run-new", "another", 1)
    own = manifest("run-own", spark.sparkContext.applicationId, 60)
    assert storage.sweep(spark) == ["run-old"]
    assert not old.exists() and new.exists() and own.exists()
    for run in ("run-new", "run-own"):
        storage.release(spark, run)
    assert not new.exists() and not own.exists()
