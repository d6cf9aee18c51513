"""Candidate pairs: who shares neighbours, how strongly, and of what kind.

Every pair that shares a neighbour gets 1/ln(group size) per shared neighbour
(times a relation weight), and only pairs that reach ``min_score`` are kept.

Groups are treated by size.  Small groups are enumerated by a self-join and
reduced per pair.  In groups of more than ``hub_degree`` members pairs grow with
the square of the group while each adds next to nothing, so as few of them are
enumerated as can be.  Their part is exact all the same:

* A pair that meets in small groups can gain from hubs at most what the
  poorer of its two users has in hubs altogether.  Pairs that fall short of
  the cut even so are dropped, the others get their hub part looked up.
* A pair that meets in hubs only must share enough of them to reach the cut.
  Per user, hubs are put in one global order, small to large, and the tail
  that together stays below the cut is set aside; the others are the head.
  Two users whose shared hubs reach the cut must share one outside both tails,
  so only heads are paired up.  What a pair has in its heads is summed exactly.
  All else it shares lies in the tail of the user whose head ends first, so
  that tail's total bounds the rest, and the same aggregate drops the pair
  unless both together reach the cut.  Only survivors are looked up in full.
* Where heads make up most of the hubs, as when many users share many hubs of
  about one size, that would look up nearly all pairs.  There all wedges of the
  hubs are summed at once, block by block; the number of wedges decides.
* Where the wedges to list outnumber the pairs of users who could reach the cut, as when
  everybody is in many of the hubs, those pairs are worked out in cells (``cells``), and
  only what could reach the cut is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrec.functions.ids import PAIR_SLICES, id_slice
from linkrec.functions.relations import (
    BUCKETS,
    COUNT_COLUMNS,
    COUNTER_CAP,
    combine_prepared,
    count_name,
    edge_weight,
    first_bucket,
    full_buckets,
    main_buckets,
    max_edge_weight,
    pack_counts,
)
from linkrec.operators.cells import near_pairs
from linkrec.operators.skew import HOT_SHARE, count_rows, hot_keys, salted_join
from linkrec.storage import stored

# Fixed value: the least score of a kept pair.
MIN_SCORE = 1.5
SCORE_DIGITS = 6
HUB_DEGREE = 1_000
# Wedges one task of the self-join gives rise to.  Tasks are sized by this, as
# the size of the input in bytes says little about the work.
WEDGES_PER_TASK = 5_000_000
# Members of one hub that meet in one task when hubs are paired up.
BLOCK_SIZE = 2_000
# Hubs are summed in full unless their heads have that many times fewer wedges.
FULL_FACTOR = 8
# What a pair of users costs in a cell, and per hub there, next to 1,000 for a listed wedge;
# and the wedges below which it does not matter.
CELL_PAIR, CELL_HUB, WEDGE = 20, 1, 1_000
MANY_WEDGES = 50_000_000
# Users in so few groups are not weighed against each other before their groups are looked up.
FEW_GROUPS = 8
# Bounds of what users have in hubs are rounded up to such parts, which shuffles as few bytes.
BOUND_PARTS = 32
# Hubs of about the same size are told apart by a hash into this many slots.
SLOTS_PER_SIZE = 64
# A bound may miss the cut by this much before it counts as below it, which
# covers rounding and the order of summation.
SLACK = 1e-5


def _prepared(members: DataFrame) -> DataFrame:
    """Bucket work that depends on one friendship only, done once per member."""
    return members.selectExpr(
        "*", f"{first_bucket(main_buckets('mask'))} AS main", f"{full_buckets('mask')} AS full"
    )


BUCKET_OF_A_AND_B = combine_prepared("a.mask", "b.mask", "a.main", "a.full", "b.full")


def wedge_weight(weight: str = "flat") -> Column:
    """Weight of a wedge from its columns ``bucket`` and ``degree``."""
    return F.expr(f"{edge_weight('bucket', weight)} / ln(degree)")


def wedges(
    members: DataFrame, tasks: int | None = None, carry: list[str] | None = None
) -> DataFrame:
    """Each pair of a group with its middle person, group size and bucket.

    For groups of bounded size only; ``pair_scores`` sees to that.  The groups
    are spread over ``tasks`` tasks.  For the columns named in ``carry`` the
    smaller of both members' values is added.
    """
    prepared = _prepared(members)
    spread = prepared.repartition(tasks, "mid_id") if tasks else prepared
    a, b = spread.alias("a"), prepared.drop("degree").alias("b")
    return a.join(b, F.expr("a.mid_id = b.mid_id and a.member_id < b.member_id")).selectExpr(
        "a.member_id AS user1",
        "b.member_id AS user2",
        "a.mid_id",
        "a.degree",
        f"{BUCKET_OF_A_AND_B} AS bucket",
        *[f"least(a.{c}, b.{c}) AS {c}" for c in carry or []],
    )


def wedge_counts(members: DataFrame) -> DataFrame:
    """(degree, bucket, n_wedges) over all groups, without listing any wedge.

    The bucket of a pair depends on the two masks alone, so members are first
    counted by mask.  Two unequal masks meet in the best bucket both have;
    masks with the same buckets are therefore counted together, and pairs of
    equal masks, which take their main bucket, are moved over afterwards.
    """
    by_mask = _prepared(
        members.groupBy("mid_id", "degree", "mask").agg(F.count("*").alias("n"))
    )
    best_of_full = f"{first_bucket('full')} AS bucket"
    choose2 = "n * (n - 1) div 2 AS n_wedges"
    equal = by_mask.selectExpr("degree", "main AS bucket", choose2)
    moved = by_mask.selectExpr("degree", best_of_full, f"-{choose2}")
    by_full = by_mask.groupBy("mid_id", "degree", "full").agg(F.sum("n").alias("n"))
    same = by_full.selectExpr("degree", best_of_full, choose2)
    # At most 2^8 bucket masks per group, whatever its size.
    a, b = by_full.alias("a"), by_full.alias("b")
    cross = a.join(b, F.expr("a.mid_id = b.mid_id and a.full < b.full")).selectExpr(
        "a.degree", f"{first_bucket('a.full & b.full')} AS bucket", "a.n * b.n AS n_wedges"
    )
    return (
        equal.union(moved)
        .union(same)
        .union(cross)
        .groupBy("degree", "bucket")
        .agg(F.sum("n_wedges").alias("n_wedges"))
        .where("n_wedges > 0")
    )


def _paired() -> list[tuple[str, ...]]:
    """The buckets two by two, as their counts share a long on the way."""
    names = list(BUCKETS)
    return [tuple(names[at : at + 2]) for at in range(0, len(names), 2)]


def _ones() -> list[str]:
    """What a wedge of ``bucket`` adds to each long that two counts share."""
    return [
        f"CASE bucket {' '.join(f'WHEN {BUCKETS[b]} THEN {1 << 32 * at}L' for at, b in enumerate(two))}"
        " ELSE 0L END"
        for two in _paired()
    ]


def _packed_sums(wedge_rows: DataFrame, weight: str, *more: Column) -> DataFrame:
    """Per pair: summed weight, and wedges per bucket in ``counts0`` and so on.

    Two counts of up to 2^31 wedges of one pair go in a long, which halves what is shuffled.
    """
    sums = [F.expr(f"sum({one}) AS counts{i}") for i, one in enumerate(_ones())]
    return wedge_rows.groupBy("user1", "user2").agg(
        F.sum(wedge_weight(weight)).alias("score"), *sums, *more
    )


def _unpacked(rows: DataFrame) -> DataFrame:
    counts = [
        f"{'shiftright' if at else ''}(counts{i}{', 32' if at else ' & 4294967295L'}) AS {count_name(b)}"
        for i, two in enumerate(_paired())
        for at, b in enumerate(two)
    ]
    left = [c for c in rows.columns if not c.startswith("counts")]
    return rows.selectExpr(*left[:3], *counts, *left[3:])


def _reduce(wedge_rows: DataFrame, weight: str, *more: Column) -> DataFrame:
    """Per pair: summed weight and wedges per bucket.  Combined map-side."""
    return _unpacked(_packed_sums(wedge_rows, weight, *more))


# -- small groups ----------------------------------------------------------


def _rests(members: DataFrame, tasks: int, carry: list[str]) -> DataFrame:
    """(user1, degree, mask, ids, masks, ...): a member with those of the group that have a
    larger id, as arrays.  For groups of bounded size only."""
    filled = members.withColumn("mask", F.coalesce("mask", F.lit(0))).where("mid_id is not null")
    of_group = (
        filled.repartition(tasks, "mid_id")
        .groupBy("mid_id")
        .agg(
            F.max("degree").alias("degree"),
            F.sort_array(F.collect_list(F.struct("member_id", "mask", *carry))).alias("m"),
        )
    )
    lists = {"member_id": "ids", "mask": "masks", **{c: f"{c}_list" for c in carry}}
    flat = of_group.selectExpr("degree", *[f"m.{c} AS {name}" for c, name in lists.items()])
    placed = flat.selectExpr("*", "posexplode(ids) AS (place, user1)")
    return placed.where("place < size(ids) - 1").selectExpr(
        "user1",
        "degree",
        *[f"{name}[place] AS {c}" for c, name in lists.items() if c != "member_id"],
        *[f"slice({name}, place + 2, size(ids)) AS {name}" for name in lists.values()],
    )


def _listed(rests: DataFrame, carry: list[str]) -> DataFrame:
    """The ``wedges`` of ``rests`` without the middle person."""
    prepared = _prepared(rests).withColumnsRenamed(
        {"mask": "mask1", "main": "main1", "full": "full1"}
    )
    met = prepared.selectExpr("*", "posexplode(ids) AS (place, user2)").where("user1 < user2")
    each = met.withColumn("mask2", F.expr("masks[place]"))
    each = each.withColumn("full2", F.expr(full_buckets("mask2")))
    bucket = combine_prepared("mask1", "mask2", "main1", "full1", "full2")
    return each.selectExpr(
        "user1",
        "user2",
        "degree",
        f"{bucket} AS bucket",
        *[f"least({c}, {c}_list[place]) AS {c}" for c in carry],
    )


def _small_sums(
    members: DataFrame,
    tasks: int,
    weight: str,
    busy: DataFrame | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """``_packed_sums`` over the wedges of groups of bounded size, plus the least of ``carry``.

    Members go to the task of their user with the rest of the group as arrays, where the
    wedges are listed and summed at once; listed earlier, each would be a wide row of the
    shuffle.  Of the users in ``busy``, who have too many wedges for one task, they are
    listed earlier.
    """
    carry = carry or []
    more = [F.max(c).alias(c) for c in carry]
    rests = _rests(members, tasks, carry)
    if busy is None:
        return _packed_sums(_listed(rests.repartition(tasks, "user1"), carry), weight, *more)
    named = F.broadcast(busy.select(F.col("member_id").alias("user1")))
    calm = rests.join(named, "user1", "left_anti").repartition(tasks, "user1")
    theirs = rests.join(named, "user1", "left_semi")
    return _packed_sums(_listed(calm, carry), weight, *more).union(
        _packed_sums(_listed(theirs, carry), weight, *more)
    )


def _busy_users(small: DataFrame, n_wedges: float) -> DataFrame | None:
    """Users whose wedges of small groups could be too many for a task, None if nobody's are."""
    if n_wedges <= WEDGES_PER_TASK:
        return None
    reach = small.groupBy("member_id").agg(F.sum(F.col("degree") - 1).alias("n_rows"))
    if reach.agg(F.max("n_rows")).first()[0] <= WEDGES_PER_TASK:
        return None
    # Each wedge counts for two users, so that there are at most 2 * HOT_SHARE of these.
    limit = max(float(WEDGES_PER_TASK), n_wedges / HOT_SHARE)
    return stored(reach.where(F.col("n_rows") > limit).select("member_id"), "busy_users")


def _with_few_hubs(
    pairs: DataFrame, hubs: DataFrame, tasks: int, most: float, min_score: float, weight: str
) -> DataFrame:
    """Add to the ``_small_sums`` of ``tasks`` tasks what the pairs share in hubs.

    For users in at most FEW_GROUPS hubs, which are held as arrays, and with no more than
    ``most`` to gain there: pairs of a user who has too little in hubs to reach the cut are
    dropped where they were summed, the others go once to the second user's hubs and meet
    them there.
    """
    theirs = hubs.groupBy("member_id").agg(
        F.collect_list(F.struct("mid_id", F.coalesce("mask", F.lit(0)).alias("mask"), "degree")).alias("m"),
        F.sum("bound").alias("in_hubs"),
    )
    first = theirs.selectExpr("member_id AS user1", "m.mid_id AS mids1", "m.mask AS masks1", "in_hubs")
    second = theirs.selectExpr(
        "member_id AS user2", "m.mid_id AS mids2", "m.mask AS masks2", "m.degree AS degrees2"
    )
    near = pairs.where(F.col("score") + most >= min_score - SLACK)
    # In the partitions of the pairs, so that these stay where they are.
    could = near.join(first.repartition(tasks, "user1"), "user1", "left").where(
        F.col("score") + F.coalesce("in_hubs", F.lit(0.0)) >= min_score - SLACK
    )
    met = could.drop("in_hubs").join(second, "user2", "left")
    # Row 0 is the pair itself, the others are every hub of the one next to each of the other.
    combined = met.selectExpr(
        "*", "explode(sequence(0, coalesce(size(mids1) * size(mids2), 0))) AS k"
    ).selectExpr("*", "(k - 1) div size(mids2) AS i", "(k - 1) % size(mids2) AS j")
    shared = combined.where("k = 0 OR mids1[i] = mids2[j]").selectExpr(
        "*", "if(k > 0, masks1[i], 0) AS mask", "if(k > 0, masks2[j], 0) AS mask2",
        "if(k > 0, degrees2[j], 2L) AS degree",
    )
    bucket = combine_prepared("mask", "mask2", "main", "full", "full2")
    each = _prepared(shared).withColumn("full2", F.expr(full_buckets("mask2")))
    each = each.withColumn("bucket", F.expr(bucket))
    own = F.col("k") == 0
    sums = [F.sum(F.when(own, F.col("score")).otherwise(wedge_weight(weight))).alias("score")]
    for i, one in enumerate(_ones()):
        sums.append(F.sum(F.when(own, F.col(f"counts{i}")).otherwise(F.expr(one))).alias(f"counts{i}"))
    return each.groupBy("user1", "user2").agg(*sums)


# -- hubs ------------------------------------------------------------------


def _bounded(hubs: DataFrame, weight: str, n_members: int) -> DataFrame:
    """Add ``bound``, the most a membership can add to any pair's score.

    A row meets each of the other user's rows in that hub, so where entries are
    repeated the bound is that many times as large as the most repeated one.
    """
    repeats = hubs.groupBy("mid_id", "member_id").agg(F.count("*").alias("n"))
    most = repeats.groupBy("mid_id").agg(F.max("n").alias("most")).where("most > 1")
    most = stored(most, "hub_repeats")  # the bounds are worked out several times
    hot = hot_keys(count_rows(hubs, "mid_id"), "mid_id", total=n_members)
    rows = salted_join(hubs, most, ["mid_id"], hot, ["member_id"], "left")
    one = f"{max_edge_weight(full_buckets('mask'), weight)} / ln(degree)"
    return rows.withColumn("bound", F.expr(f"coalesce(most, 1) * {one}")).drop("most")


def _hub_heads(hubs: DataFrame, min_score: float, n_members: int) -> DataFrame:
    """The hub memberships outside their user's tail, with ``last_slot`` and ``tail``.

    ``last_slot`` is where the user's head ends, ``tail`` the sum of bounds after it.  A
    user's bounds are first summed per slot of the global order, which leaves a bounded
    number of rows per user however many hubs they are in.
    """
    slot = F.ceil(F.log2("degree")) * SLOTS_PER_SIZE + F.pmod(
        F.xxhash64("mid_id"), F.lit(SLOTS_PER_SIZE)
    )
    placed = hubs.withColumn("slot", slot)
    per_slot = placed.groupBy("member_id", "slot").agg(
        F.sum("bound").alias("bound"), F.count("*").alias("n_rows")
    )
    from_top = Window.partitionBy("member_id").orderBy(F.desc("slot"))
    reached = F.col("so_far") >= min_score - SLACK
    ends = (
        per_slot.withColumn("so_far", F.sum("bound").over(from_top))
        .groupBy("member_id")
        .agg(
            F.max(F.when(reached, F.col("slot"))).alias("last_slot"),
            F.max(F.when(reached, 0.0).otherwise(F.col("so_far"))).alias("tail"),
        )
        .where("last_slot is not null")
    )
    sizes = per_slot.groupBy("member_id").agg(F.sum("n_rows").alias("n_rows"))
    hot = hot_keys(sizes, "member_id", total=n_members)
    return (
        salted_join(placed, ends, ["member_id"], hot, ["mid_id"])
        .where("slot <= last_slot")
        .select("mid_id", "member_id", "mask", "degree", "last_slot", "tail")
    )


def _block_wedges(
    rows: DataFrame, sizes: DataFrame, n_rows: int, n_wedges: float, block_size: int, *more: str
) -> DataFrame:
    """Wedges (user1, user2, degree, bucket) of groups of any size, plus columns ``more``.

    A group is cut into blocks and each two blocks meet in a task of their own, so that
    one huge group is spread over many tasks; there are as many tasks as the wedges need.
    """
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(parallel, int(n_wedges // WEDGES_PER_TASK) + 1)
    hot = hot_keys(sizes, "mid_id", total=n_rows)
    placed = salted_join(_prepared(rows), sizes, ["mid_id"], hot, ["member_id"])
    n_blocks = F.ceil(F.col("n_rows") / block_size).cast("int")
    placed = placed.withColumn("n_blocks", n_blocks).withColumn(
        "block", F.pmod(F.xxhash64("member_id"), "n_blocks").cast("int")
    )
    low = placed.select(
        "*",
        F.col("block").alias("i"),
        F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("j"),
    )
    high = placed.select(
        "*",
        F.explode(F.sequence(F.lit(0), "block")).alias("i"),
        F.col("block").alias("j"),
    )
    cell = ["mid_id", "i", "j"]
    return (
        low.repartition(tasks, *cell).alias("a").join(high.alias("b"), cell)
        .where("a.member_id <> b.member_id and (i < j or a.member_id < b.member_id)")
        .selectExpr(
            "least(a.member_id, b.member_id) AS user1",
            "greatest(a.member_id, b.member_id) AS user2",
            "a.degree",
            f"{BUCKET_OF_A_AND_B} AS bucket",
            *more,
        )
    )


def _squares(sizes: DataFrame) -> tuple[int, float]:
    """Rows of all groups, and about how many wedges they have."""
    return tuple(
        x or 0
        for x in sizes.selectExpr("sum(n_rows)", "sum(double(n_rows) * n_rows / 2)").first()
    )


def _cells_cost_less(n_users: int, n_hubs: int, n_wedges: float) -> bool:
    """Whether to work out the pairs of so many users rather than list the wedges."""
    in_cells = n_users**2 / 2 * (CELL_PAIR + CELL_HUB * n_hubs)
    return n_wedges > MANY_WEDGES and in_cells < WEDGE * n_wedges


def _with_near(near: DataFrame, small: DataFrame) -> DataFrame:
    """``near`` plus what its pairs have in the ``small`` groups."""
    sums = ["score", *COUNT_COLUMNS]
    theirs = small.select("user1", "user2", *[F.col(c).alias(f"small_{c}") for c in sums])
    both = near.join(theirs, ["user1", "user2"], "left")
    return both.select(
        "user1", "user2", *[(F.col(c) + F.coalesce(f"small_{c}", F.lit(0))).alias(c) for c in sums]
    )


def _head_pairs(
    heads: DataFrame, min_score: float, weight: str = "flat", block_size: int = BLOCK_SIZE
) -> DataFrame:
    """(user1, user2) of the pairs in the stored ``heads`` that could reach the cut.

    A pair's weights in its heads are summed map-side, next to the most that it can have
    in tails, and it leaves with that sum if both fall short.
    """
    sizes = count_rows(heads, "mid_id")
    tail = """CASE WHEN a.last_slot < b.last_slot THEN a.tail
                   WHEN b.last_slot < a.last_slot THEN b.tail
                   ELSE least(a.tail, b.tail) END AS tail"""
    met = _block_wedges(heads, sizes, *_squares(sizes), block_size, tail)
    sums = met.groupBy("user1", "user2").agg(
        F.sum(wedge_weight(weight)).alias("sure"), F.max("tail").alias("tail")
    )
    return sums.where(F.col("sure") + F.col("tail") >= min_score - SLACK).select("user1", "user2")


def _wedges_of(keys: DataFrame, members: DataFrame) -> DataFrame:
    """The wedges of given pairs.  Looks up the groups of the user who is in
    fewer of them, then whether the other user is there too.

    ``keys`` and ``members`` should be stored tables, or filters of such."""
    members = members.select("mid_id", "member_id", "mask", "degree")
    sizes = count_rows(members, "member_id", "n_groups")
    users = keys.select(F.explode(F.array("user1", "user2")).alias("user"))
    most = sizes.agg(F.max("n_groups")).first()[0] or 0
    # A pair of a user becomes a row for each of their groups, so that many rows are weighed.
    if most <= FEW_GROUPS:
        work = count_rows(users, "user").withColumn("n_rows", F.col("n_rows") * most)
        hot = hot_keys(work, "user", total=2 * most * keys.count())
        keys = keys.selectExpr("user1", "user2", "user1 AS member_id", "user2 AS other_id")
    else:
        work = (
            count_rows(users, "user")
            .join(sizes.withColumnRenamed("member_id", "user"), "user")
            .selectExpr("user", "n_rows * n_groups AS n_rows")
        )
        total = work.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        hot = hot_keys(work, "user", total=total)
        for user in ("user1", "user2"):
            named = sizes.withColumnsRenamed({"member_id": user, "n_groups": f"n_{user}"})
            keys = salted_join(keys, named, [user], hot, ["user1", "user2"])
        keys = keys.selectExpr(
            "user1",
            "user2",
            "if(n_user1 <= n_user2, user1, user2) AS member_id",
            "if(n_user1 <= n_user2, user2, user1) AS other_id",
        )
    prepared = _prepared(members)
    one = prepared.selectExpr("member_id", "mid_id", "degree", "struct(mask, main, full) AS a")
    other = prepared.selectExpr("member_id AS other_id", "mid_id", "struct(mask, full) AS b")
    found = salted_join(keys, one, ["member_id"], hot, ["other_id"])
    both = salted_join(found, other, ["other_id", "mid_id"], hot, ["member_id", "mid_id"])
    return both.selectExpr(
        "user1", "user2", "mid_id", "degree", f"{BUCKET_OF_A_AND_B} AS bucket"
    )


# -- scored pairs ----------------------------------------------------------


def pair_totals(
    members: DataFrame,
    min_score: float = MIN_SCORE,
    weight: str = "flat",
    hub_degree: int = HUB_DEGREE,
) -> DataFrame:
    """(user1, user2, score, n_<bucket>...) of all pairs that reach the cut.

    ``members`` should be a stored table: it is looked at up front to see
    whether there are hubs at all, and read several times if there are.
    """
    look = members.selectExpr(
        "count(*) AS n_members",
        f"sum(if(degree > {hub_degree}, 1, 0)) AS n_in_hubs",
        f"sum(if(degree > {hub_degree}, 0, (degree - 1) / 2)) AS n_wedges",
    ).first()
    parallel = members.sparkSession.sparkContext.defaultParallelism
    tasks = max(parallel, int((look["n_wedges"] or 0) // WEDGES_PER_TASK) + 1)
    small = members.where(F.col("degree") <= hub_degree)
    hubs = members.where(F.col("degree") > hub_degree)
    busy = _busy_users(small, look["n_wedges"] or 0)
    if look["n_in_hubs"]:
        n_members = look["n_members"]
        totals = _totals_with_hubs(small, hubs, n_members, tasks, busy, min_score, weight)
    else:
        totals = _unpacked(_small_sums(small, tasks, weight, busy))
    return totals.withColumn("score", F.round("score", SCORE_DIGITS)).where(
        F.col("score") >= min_score
    )


def _totals_with_hubs(
    small: DataFrame,
    hubs: DataFrame,
    n_members: int,
    tasks: int,
    busy: DataFrame | None,
    min_score: float,
    weight: str,
) -> DataFrame:
    hubs = _bounded(hubs, weight, n_members)
    in_hubs = hubs.groupBy("member_id").agg(
        F.sum("bound").alias("in_hubs"), F.count("*").alias("n_hubs")
    )
    in_hubs = stored(in_hubs, "in_hubs")
    most_bound, most_hubs = in_hubs.agg(F.max("in_hubs"), F.max("n_hubs")).first()
    alone = most_bound is not None and most_bound >= min_score - SLACK
    if not alone and busy is None and most_hubs <= FEW_GROUPS:
        sums = _small_sums(small, tasks, weight)
        return _unpacked(_with_few_hubs(sums, hubs, tasks, most_bound, min_score, weight))
    hot = hot_keys(count_rows(small, "member_id"), "member_id", total=n_members)
    rough = in_hubs.select(
        "member_id", (F.ceil(F.col("in_hubs") * BOUND_PARTS) / BOUND_PARTS).alias("in_hubs")
    )
    small = salted_join(small, rough, ["member_id"], hot, ["mid_id"], "left").fillna(
        0.0, ["in_hubs"]
    )
    sums = _unpacked(_small_sums(small, tasks, weight, busy, ["in_hubs"]))
    from_small = stored(
        sums.where(F.col("score") + F.col("in_hubs") >= min_score - SLACK), "small_group_pairs"
    )
    pair, done = ["user1", "user2"], None
    keys = from_small.where("in_hubs > 0").select(*pair)
    if alone:
        able = in_hubs.where(F.col("in_hubs") >= min_score - SLACK)
        heads = stored(_hub_heads(hubs, min_score, n_members), "hub_heads")
        plain = hubs.select("mid_id", "member_id", "mask", "degree")
        sizes = count_rows(hubs, "mid_id")
        n_rows, n_wedges = _squares(sizes)
        head_wedges = _squares(count_rows(heads, "mid_id"))[1]
        in_full = n_wedges <= FULL_FACTOR * head_wedges
        n_users, n_theirs = able.agg(F.count("*"), F.sum("n_hubs")).first()
        n_hubs = sizes.count()
        if _cells_cost_less(n_users, n_hubs, n_wedges if in_full else head_wedges):
            hot = hot_keys(count_rows(hubs, "member_id"), "member_id", total=n_members)
            theirs = salted_join(
                plain, able.select("member_id"), ["member_id"], hot, ["mid_id"], "left_semi"
            )
            near = stored(near_pairs(theirs, n_theirs, n_users, min_score, weight), "near_pairs")
            near = near.selectExpr("user1", "user2", "score", *[f"bigint({c}) AS {c}" for c in COUNT_COLUMNS])
            # Others that meet in small groups as well are looked up.
            met = stored(near.select(*pair).join(from_small.select(*pair), pair), "met_pairs")
            keys = stored(keys.join(met, pair, "left_anti"), "hub_pairs")
            done = _with_near(near, from_small)
            from_small = from_small.join(met, pair, "left_anti")
            hub_wedges = _wedges_of(keys, hubs)
        elif in_full:
            hub_wedges = _block_wedges(plain, sizes, n_rows, n_wedges, BLOCK_SIZE)
        else:
            reach = _head_pairs(heads, min_score, weight)
            keys = stored(keys.union(reach).distinct(), "hub_pairs")
            hub_wedges = _wedges_of(keys, hubs)
    else:
        hub_wedges = _wedges_of(keys, hubs)
    # What small groups have summed up and wedges of hubs meet in one aggregate.
    ones = [F.expr(f"bigint(bucket = {code})").alias(count_name(b)) for b, code in BUCKETS.items()]
    each = hub_wedges.select("user1", "user2", wedge_weight(weight).alias("score"), *ones)
    sums = [F.sum(c).alias(c) for c in ["score", *COUNT_COLUMNS]]
    summed = from_small.drop("in_hubs").unionByName(each).groupBy(*pair).agg(*sums)
    return summed if done is None else done.unionByName(summed)


def pair_scores(members: DataFrame, **options) -> DataFrame:
    """pairs(user1, user2, score, n_<bucket>..., packed).

    Counts stop at 7.  ``count_close_family=False`` leaves close family
    uncounted, as a run that must match uncorrected counters needs.
    """
    count_close_family = options.pop("count_close_family", True)
    totals = pair_totals(members, **options)
    counts = {b: f"int(least({count_name(b)}, {COUNTER_CAP}))" for b in BUCKETS}
    if not count_close_family:
        counts["CLOSE_FAMILY"] = "0"
    return totals.selectExpr(
        "user1",
        "user2",
        "score",
        *[f"{n} AS {count_name(b)}" for b, n in counts.items()],
        f"{pack_counts(counts)} AS packed",
    )


def wedges_of_pairs(
    pairs: DataFrame, members: DataFrame, weight: str = "flat", hub_degree: int = HUB_DEGREE
) -> DataFrame:
    """Why each pair is a candidate: its shared neighbours, one row each.

    Where groups of up to ``hub_degree`` members have fewer wedges than the pairs' users have
    groups to look up, their wedges are listed and joined with the pairs.  ``pairs`` and
    ``members`` should be stored tables.
    """
    keys = pairs.select("user1", "user2")
    in_small = F.col("degree") <= hub_degree
    look = members.select(
        F.count("*"),
        F.approx_count_distinct("member_id"),
        F.coalesce(F.sum(F.when(in_small, (F.col("degree") - 1) / 2)), F.lit(0.0)),
    ).first()
    n_members, n_users, n_wedges = look
    if n_wedges <= keys.count() * n_members / max(1, n_users):
        parallel = members.sparkSession.sparkContext.defaultParallelism
        small = wedges(members.where(in_small), max(parallel, int(n_wedges // WEDGES_PER_TASK) + 1))
        listed = small.withColumnsRenamed({"user1": "low", "user2": "high"})
        named = keys.selectExpr("*", "least(user1, user2) AS low", "greatest(user1, user2) AS high")
        looked_up = _wedges_of(keys, members.where(~in_small))
        found = listed.join(named, ["low", "high"]).select(looked_up.columns).unionByName(looked_up)
    else:
        found = _wedges_of(keys, members)
    return found.withColumn("weight", wedge_weight(weight))


def pair_slice(pairs: DataFrame, number: int, slices: int = PAIR_SLICES) -> DataFrame:
    """One slice of the pairs by the first user's id."""
    return pairs.where(f"{id_slice('user1', slices)} = {number}")
