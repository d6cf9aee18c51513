"""Parquet stores of the two intermediate results: groups and scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrec.functions.ids import PAIR_SLICES, id_slice
from linkrec.schemas import GROUPS
from linkrec.storage import write_once


def write_groups(groups: DataFrame, path: str) -> bool:
    return write_once(groups, path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUPS).parquet(path)


def write_pairs(pairs: DataFrame, path: str, slices: int = PAIR_SLICES) -> bool:
    """Write pairs in slices by the first user's id, all in one job.

    The rebalance hint lets Spark join small slices and split large ones, so a
    user with a great share of the pairs does not make one giant task or file.
    """
    sliced = pairs.withColumn("slice", F.expr(id_slice("user1", slices)))
    return write_once(sliced.hint("rebalance", "slice"), path, ["slice"])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """All slices; a filter on ``slice`` reads only the folders it names."""
    return spark.read.parquet(path)
