"""Intermediate tables in the folder the cluster shares.

A written table cuts lineage and survives the loss of any executor, and later
reads of it get column pruning and filter pushdown.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="linkrec-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# Runs that are under way in this process, innermost last; what is stored belongs to that one.
_RUNS: list[str] = []
MANIFEST = "run.json"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    run = f"{_RUNS[-1]}/" if _RUNS else ""
    return f"{shared_folder(spark)}/linkrec/{run}{uuid.uuid4().hex}/{name}"


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """A run whose stored tables go when it ends, be it by a failure.

    Results are read from stored tables, so they have to be written or collected inside.
    A manifest names the application and the start, so that ``sweep`` finds the tables of
    a run whose driver was lost.  Tables kept in a folder of their own stay.
    """
    run = f"run-{uuid.uuid4().hex}"
    files, place = _files(spark, f"{shared_folder(spark)}/linkrec/{run}/{MANIFEST}")
    told = {"application": spark.sparkContext.applicationId, "started": time.time()}
    out = files.create(place)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    _RUNS.append(run)
    try:
        yield run
    finally:
        _RUNS.remove(run)
        release(spark, run)


def release(spark: SparkSession, run: str) -> None:
    """Remove all that a run has stored, with the catalog's entries for it."""
    folder = f"{shared_folder(spark)}/linkrec/{run}"
    for t in spark.catalog.listTables(pattern="linkrec_*"):
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED `{t.name}`").where("col_name = 'Location'")
        if f"/linkrec/{run}/" in (rows.first() or {"data_type": ""})["data_type"]:
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    files, place = _files(spark, folder)
    files.delete(place, True)


def sweep(spark: SparkSession, hours: float = 48.0) -> list[str]:
    """Release runs of other applications that began more than ``hours`` ago; their names.

    Give more hours than any run takes, as a run that goes on elsewhere cannot be told apart.
    """
    files, root = _files(spark, f"{shared_folder(spark)}/linkrec")
    gone = []
    for status in files.listStatus(root) if files.exists(root) else []:
        run = status.getPath().getName()
        manifest = f"{shared_folder(spark)}/linkrec/{run}/{MANIFEST}"
        if not run.startswith("run-") or not files.exists(_files(spark, manifest)[1]):
            continue
        told = json.loads(spark.read.text(manifest, wholetext=True).first()["value"])
        own = told["application"] == spark.sparkContext.applicationId
        if not own and told["started"] < time.time() - hours * 3600:
            release(spark, run)
            gone.append(run)
    return gone


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _is_complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def input_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, modificationTime) of the files under ``paths``, without reading them."""
    listed = spark.read.format("binaryFile").load(list(paths))
    return listed.select("path", "length", "modificationTime")


def input_identity(spark: SparkSession, *paths: str) -> str:
    """Stands for the files under ``paths``: where they are, how long, and since when."""
    file = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    told = input_files(spark, *paths).agg(F.count("*"), F.sum("length"), F.sum(file)).first()
    return sha256(repr((paths, tuple(told))).encode()).hexdigest()[:16]


def kept(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], folder: str | None = None
) -> DataFrame:
    """The table ``name`` of ``folder``: read if a run has finished it before,
    else built and written.  Without a folder it is always built anew."""
    if folder is None:
        return stored(build(), name)
    path = f"{folder}/{name}"
    if not _is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """Write ``df`` to ``path`` unless a finished table is already there.

    A table without its success marker is a run that died half-way and is
    written anew.  Returns whether anything was written.
    """
    if _is_complete(df.sparkSession, path):
        return False
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return True
