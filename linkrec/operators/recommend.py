"""From scored pairs to ranked suggestions per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrec.functions.ids import is_holdout

# Fixed value: most suggestions per user.
TOP_K = 100


def both_directions(scored: DataFrame, score: str) -> DataFrame:
    """(user_id, friend_id, score): each pair once for either user, in one scan."""
    one, two = F.col("user1"), F.col("user2")
    ends = F.array(
        F.struct(one.alias("user_id"), two.alias("friend_id")),
        F.struct(two.alias("user_id"), one.alias("friend_id")),
    )
    return scored.select(F.explode(ends).alias("e"), F.col(score).alias("score")).select(
        "e.user_id", "e.friend_id", "score"
    )


def for_holdout(directed: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows of held-out users that reach the threshold."""
    kept = directed.where(is_holdout("user_id"))
    return kept if threshold is None else kept.where(F.col("score") >= threshold)


def top_k(directed: DataFrame, k: int = TOP_K) -> DataFrame:
    """Add ``rank`` and keep each user's best k; ties go to the smaller id.

    The row_number filter is pushed below the shuffle, so at most k rows per
    user leave a map task.
    """
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "friend_id")
    return directed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def suggestion_lists(ranked: DataFrame) -> DataFrame:
    """(user_id, friends): the suggested ids in rank order, at most k per user."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "friend_id")))
    return ranked.groupBy("user_id").agg(
        F.transform(entries, lambda x: x["friend_id"]).alias("friends")
    )
