"""Known friendships as labels, hold-out users and repeatable splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrec.functions.ids import is_holdout, split_number
from linkrec.operators.graph import list_owners
from linkrec.operators.skew import count_rows, hot_keys, salted_join

# Shares of the base, ensemble and validation splits, and the seed.
SPLIT_WEIGHTS = [0.7, 0.2, 0.1]
SPLIT_SEED = 11
BASE, ENSEMBLE, VALIDATION = 0, 1, 2


def positive_pairs(edges: DataFrame, n_edges: int | None = None) -> DataFrame:
    """(user1, user2, label = 1.0) for listed friends, smaller id first, where
    both are list owners."""
    owners = list_owners(edges).withColumnRenamed("user_id", "friend_id")
    forward = edges.where("friend_id > user_id").select("user_id", "friend_id")
    hot = hot_keys(count_rows(forward, "friend_id"), "friend_id", total=n_edges)
    known = salted_join(forward, owners, ["friend_id"], hot, ["user_id"], "left_semi")
    return known.select(
        F.col("user_id").alias("user1"), F.col("friend_id").alias("user2"), F.lit(1.0).alias("label")
    )


def label_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with ``label``: 1.0 if the first user lists the second, else 0.0.

    Both users of a candidate pair own lists, so no owner check is needed.
    """
    known = edges.where("friend_id > user_id").select(
        F.col("user_id").alias("user1"), F.col("friend_id").alias("user2"), F.lit(1.0).alias("label")
    )
    return pairs.join(known, ["user1", "user2"], "left").fillna(0.0, ["label"])


def non_friends(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs whose first user does not list the second."""
    known = edges.where("friend_id > user_id").select(
        F.col("user_id").alias("user1"), F.col("friend_id").alias("user2")
    )
    return pairs.join(known, ["user1", "user2"], "left_anti")


def without_friends(labeled: DataFrame) -> DataFrame:
    """The same for pairs that carry a label."""
    return labeled.where("label = 0.0")


def train_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs without a held-out user."""
    return pairs.where(f"not {is_holdout('user1')} and not {is_holdout('user2')}")


def test_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with at least one held-out user."""
    return pairs.where(f"{is_holdout('user1')} or {is_holdout('user2')}")


def with_split(
    pairs: DataFrame, weights: list[float] = SPLIT_WEIGHTS, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add ``split`` (0, 1, ...), which depends on the pair and the seed only,
    so it is the same after any repartitioning or recomputation."""
    return pairs.withColumn("split", F.expr(split_number("user1", "user2", weights, seed)))


def random_splits(
    pairs: DataFrame, weights: list[float] = SPLIT_WEIGHTS, seed: int = SPLIT_SEED
) -> list[DataFrame]:
    """Spark's own seeded split, which depends on how the rows are partitioned."""
    return pairs.randomSplit(weights, seed)
