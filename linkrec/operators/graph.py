"""Reshaping of friend lists: flat edges, owners, and who-lists-this-person groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrec.functions.relations import invert
from linkrec.operators.skew import count_rows, hot_keys, salted_join
from linkrec.storage import stored

# Smallest friend list and smallest group that take part.
MIN_FRIENDS = 2
MIN_DEGREE = 2
# Most members that one exported list holds.
LIST_SIZE = 10_000
# Ranges of ids that a list's worth of a long group is cut into to find places.
RANGES_PER_LIST = 16


def flatten(adjacency: DataFrame, duplicates: str = "merge") -> DataFrame:
    """(user_id, friends) to edges(user_id, friend_id, mask).

    ``merge`` makes one edge of repeated entries, with all their relation
    types; ``keep`` leaves them, and each then counts.
    """
    edges = adjacency.select("user_id", F.explode("friends").alias("f")).select(
        "user_id", "f.friend_id", "f.mask"
    )
    if duplicates == "keep":
        return edges
    if duplicates != "merge":
        raise ValueError(f"unknown duplicates mode: {duplicates}")
    return edges.groupBy("user_id", "friend_id").agg(F.bit_or("mask").alias("mask"))


def list_owners(edges: DataFrame) -> DataFrame:
    return edges.select("user_id").distinct()


def _lone_edges(edges: DataFrame) -> DataFrame:
    """The edges of owners who list one person only."""
    sizes = edges.groupBy("user_id").agg(
        F.count("*").alias("n_rows"), F.max("friend_id").alias("friend_id")
    )
    return sizes.where("n_rows = 1").select("user_id", "friend_id")


def active_owner_edges(
    edges: DataFrame,
    min_friends: int = MIN_FRIENDS,
    n_edges: int | None = None,
    lone: DataFrame | None = None,
) -> DataFrame:
    """Edges of owners who list at least ``min_friends``.

    Here and below ``n_edges`` may give the number of edges if it is known, as it is of a
    stored table, and ``lone`` the ``_lone_edges``.
    """
    if min_friends == 2:
        # The rows to drop are known by both ids.  Joining on both spreads
        # even a giant list evenly and keeps the partitioning that merging
        # duplicates has left.
        lone = _lone_edges(edges) if lone is None else lone
        return edges.join(lone, ["user_id", "friend_id"], "left_anti")
    sizes = count_rows(edges, "user_id")
    owners = sizes.where(F.col("n_rows") >= min_friends).select("user_id")
    hot = hot_keys(sizes, "user_id", total=n_edges)
    return salted_join(edges, owners, ["user_id"], hot, ["friend_id"], "left_semi")


def reverse_edges(edges: DataFrame, inversion: str = "canonical") -> DataFrame:
    """(mid_id, member_id, mask): each edge seen from the person listed."""
    return edges.selectExpr(
        "friend_id AS mid_id", "user_id AS member_id", f"{invert('mask', inversion)} AS mask"
    )


def with_degree(
    reversed_edges: DataFrame,
    min_degree: int = MIN_DEGREE,
    n_edges: int | None = None,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """Add the group size ``degree`` and drop groups below ``min_degree``.

    ``degrees`` may give (mid_id, degree) where there is a shorter way to it.
    """
    if degrees is None:
        degrees = count_rows(reversed_edges, "mid_id", "degree")
    hot = hot_keys(degrees, "mid_id", "degree", n_edges)
    kept = degrees.where(F.col("degree") >= min_degree)
    return salted_join(reversed_edges, kept, ["mid_id"], hot, ["member_id"])


def _active_degrees(edges: DataFrame, lone: DataFrame) -> DataFrame:
    """Group sizes over active owners: all edges less the lone ones, so that
    the join which drops those need not be run twice."""
    listed = edges.selectExpr("friend_id AS mid_id", "1L AS n")
    lone = lone.selectExpr("friend_id AS mid_id", "-1L AS n")
    return listed.union(lone).groupBy("mid_id").agg(F.sum("n").alias("degree"))


def group_members(
    edges: DataFrame,
    min_friends: int = MIN_FRIENDS,
    min_degree: int = MIN_DEGREE,
    inversion: str = "canonical",
    n_edges: int | None = None,
) -> DataFrame:
    """members(mid_id, member_id, mask, degree): the groups in flat form.

    Of a stored table the lone edges, which are asked for twice, are found once and stored;
    as long as they are few, Spark then drops them without a shuffle of all edges.
    """
    lone = _lone_edges(edges) if min_friends == 2 else None
    if lone is not None and n_edges is not None:
        lone = stored(lone, "lone_edges")
    active = reverse_edges(active_owner_edges(edges, min_friends, n_edges, lone), inversion)
    degrees = _active_degrees(edges, lone) if lone is not None else None
    return with_degree(active, min_degree, n_edges, degrees)


def _with_places(members: DataFrame, list_size: int) -> DataFrame:
    """Add ``place``, the number of a member in its group by id.

    A group is cut into ranges of ids: places are counted within a range, and only the
    sizes of the ranges are summed up per group.
    """
    spans = members.groupBy("mid_id").agg(
        F.min("member_id").alias("least"), F.max("member_id").alias("most")
    )
    hot = hot_keys(count_rows(members, "mid_id"), "mid_id")
    spanned = salted_join(members, spans, ["mid_id"], hot, ["member_id"])
    ranges = F.ceil(F.col("degree") / list_size) * RANGES_PER_LIST
    width = (F.col("most") - F.col("least")) / ranges
    number = F.floor((F.col("member_id") - F.col("least")) / F.greatest(width, F.lit(1.0)))
    ranged = spanned.withColumn("range", number.cast("long")).drop("least", "most")
    before = Window.partitionBy("mid_id").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = ranged.groupBy("mid_id", "range").agg(F.count("*").alias("n"))
    offsets = sizes.select(
        "mid_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("mid_id", "range").orderBy("member_id", "mask")
    return (
        ranged.withColumn("own", F.row_number().over(within))
        .join(offsets, ["mid_id", "range"])
        .withColumn("place", F.col("own") + F.col("before"))
        .drop("own", "before", "range")
    )


def group_lists(members: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """Groups as sorted lists, for export.

    A group of more than ``list_size`` members is written as several lists
    (``chunk`` 0, 1, ...), so that no row holds an unbounded group.  The lists in the
    order of their chunks are the sorted group.  All but the last are full.
    """
    long = F.col("degree") > list_size
    short = members.where(~long).withColumn("chunk", F.lit(0))
    placed = _with_places(members.where(long), list_size)
    chunk = F.floor((F.col("place") - 1) / list_size).cast("int")
    cut = placed.withColumn("chunk", chunk).select(*short.columns)
    return short.unionByName(cut).groupBy("mid_id", "chunk", "degree").agg(
        F.array_sort(F.collect_list(F.struct("member_id", "mask"))).alias("members")
    )


def explode_groups(groups: DataFrame) -> DataFrame:
    """The flat members behind ``group_lists``."""
    return groups.select("mid_id", "degree", F.explode("members").alias("m")).select(
        "mid_id", "m.member_id", "m.mask", "degree"
    )
