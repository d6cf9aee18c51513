import collections
import itertools
import math
import random

import pyarrow as pa
import pytest

import brute
from linkrec.functions import relations as rel
from linkrec.operators import candidates as cand
from linkrec.operators import cells, graph, skew
from linkrec.operators.skew import count_rows, hot_keys, salted_join
from linkrec.storage import stored

EDGES = "user_id long, friend_id long, mask int"


def random_members(seed, users=60, small=40, hubs=30):
    """Small groups and a number of hubs that most users are in."""
    rng, rows = random.Random(seed), []
    choices = [0, 2, 4, 8, 12, 256, 512, 1024, 1024, 32768]
    for user in range(users):
        friends = rng.sample(range(1000, 1000 + small), rng.randint(2, 8))
        friends += [h for h in range(hubs) if rng.random() < (0.9 if user < 20 else 0.3)]
        rows += [(f, user, rng.choice(choices)) for f in friends]
    degree = {}
    for mid, _, _ in rows:
        degree[mid] = degree.get(mid, 0) + 1
    return [(m, u, t, degree[m]) for m, u, t in rows if degree[m] >= 2]


def as_table(spark, rows):
    schema = "mid_id long, member_id long, mask int, degree long"
    return stored(spark.createDataFrame(rows, schema), "members")


def same_pairs(pairs, want):
    rows = {(r["user1"], r["user2"]): r for r in pairs.collect()}
    assert {k: tuple(r[c] for c in rel.COUNT_COLUMNS) for k, r in rows.items()} == {
        k: counts for k, (_, counts) in want.items()
    }
    for key, (score, _) in want.items():
        assert rows[key]["score"] == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize("mode", ["flat", "typed"])
@pytest.mark.parametrize("hub_degree, full", [(1, 0), (1, 1e9), (12, 0), (25, 1e9), (1000, 8)])
def test_pairs_equal_brute_force(spark, monkeypatch, mode, hub_degree, full):
    monkeypatch.setattr(cand, "FULL_FACTOR", full)  # heads only, all wedges, either
    rows = random_members(3)
    want = brute.pairs([r[:3] for r in rows], 3.0, mode)
    assert 100 < len(want) < 1700
    got = cand.pair_scores(
        as_table(spark, rows), min_score=3.0, weight=mode, hub_degree=hub_degree
    )
    same_pairs(got, want)


@pytest.mark.parametrize("mode", ["flat", "typed"])
def test_repeated_entries_count_each_whatever_is_a_hub(spark, mode):
    rows = random_members(4, users=30)
    rows += [r for i, r in enumerate(rows) for _ in range(i % 3) if i % 5 == 0]
    table = as_table(spark, rows)
    sets = [
        sorted(
            (r["user1"], r["user2"], round(r["score"], 5), *(r[c] for c in rel.COUNT_COLUMNS))
            for r in cand.pair_scores(
                table, min_score=4.0, weight=mode, hub_degree=hub_degree
            ).collect()
        )
        for hub_degree in (1, 12, 1000)
    ]
    assert sets[0] == sets[1] == sets[2] and sets[0]


def test_pairs_that_meet_in_hubs_only(spark):
    rows = [(hub, user, 4, 30) for hub in range(12) for user in range(30)]
    want = brute.pairs([r[:3] for r in rows], 1.5)
    assert len(want) == 435
    same_pairs(cand.pair_scores(as_table(spark, rows), hub_degree=5), want)


def test_hot_keys_are_salted_to_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_SHARE", 50)
    rows = random_members(4)
    want = brute.pairs([r[:3] for r in rows], 2.5)
    got = cand.pair_scores(as_table(spark, rows), min_score=2.5, hub_degree=15)
    same_pairs(got, want)


def test_hub_heads_are_few(spark):
    rows = random_members(5)
    hubs = cand._bounded(as_table(spark, rows).where("degree > 15"), "flat", len(rows))
    heads = cand._hub_heads(hubs, 2.0, hubs.count())
    assert 0 < heads.count() < hubs.count()


def heads_table(spark, rows):
    """(mid_id, member_id, mask, degree, last_slot, tail) as a stored table."""
    schema = "mid_id long, member_id long, mask int, degree long, last_slot long, tail double"
    return stored(spark.createDataFrame(rows, schema).repartition(4), "heads")


def test_blocks_meet_once(spark):
    heads = heads_table(spark, [(1, user, 4, 3, 9, 0.0) for user in range(50)])
    one = 1 / math.log(3)
    found = cand._head_pairs(heads, one, block_size=7).collect()
    assert sorted((r["user1"], r["user2"]) for r in found) == [
        (a, b) for a in range(50) for b in range(a + 1, 50)
    ]
    # Met twice the sum would reach this.
    assert cand._head_pairs(heads, 1.5 * one, block_size=7).count() == 0


def test_the_tail_that_counts_is_that_of_the_shorter_head(spark):
    one = 1 / math.log(3)
    rows = [(1, 10, 4, 3, 5, 0.4), (1, 20, 4, 3, 7, 9.0), (1, 30, 4, 3, 7, 0.1)]
    for least, want in [
        (one + 0.4, {(10, 20), (10, 30)}),
        (one + 0.1, {(10, 20), (10, 30), (20, 30)}),
        (one + 0.41, set()),
    ]:
        found = cand._head_pairs(heads_table(spark, rows), least).collect()
        assert {tuple(r) for r in found} == want


@pytest.mark.parametrize("weight", ["flat", "typed"])
def test_dense_hubs_list_only_what_could_reach_the_cut(spark, monkeypatch, weight):
    rng = random.Random(8)
    rows = [
        (hub, user, rng.choice([0, 4, 8, 512, 1024, 1 << 20]))
        for user in range(300)
        for hub in sorted(rng.sample(range(200), 60))
    ]
    sizes = collections.Counter(hub for hub, *_ in rows)
    rows = [(*r, sizes[r[0]]) for r in rows]
    every = brute.pairs([r[:3] for r in rows], 0.0, weight)
    least = round(sorted(score for score, _ in every.values())[-40], 3)
    want = {p: found for p, found in every.items() if round(found[0], 6) >= least}
    assert 30 < len(want) < 50
    members = as_table(spark, rows)
    for full in (0, 1e9):
        monkeypatch.setattr(cand, "FULL_FACTOR", full)
        got = cand.pair_scores(members, min_score=least, weight=weight, hub_degree=10)
        same_pairs(got, want)
    hubs = cand._bounded(members, weight, len(rows))
    heads = stored(cand._hub_heads(hubs, least, len(rows)), "heads")
    listed = {tuple(r) for r in cand._head_pairs(heads, least, weight).collect()}
    together = heads.select("mid_id", "member_id").collect()
    by_hub = collections.defaultdict(list)
    for hub, user in together:
        by_hub[hub].append(user)
    met = {(min(a, b), max(a, b)) for m in by_hub.values() for a in m for b in m if a != b}
    # All that reach the cut, no pair that its bound rules out, and fewer than meet.
    assert set(want) <= listed <= met
    head = {(r.mid_id, r.member_id): r for r in heads.collect()}
    weights = collections.Counter()
    for u, v, m, d, b in brute.wedges([r[:3] for r in rows]):
        if (m, u) in head and (m, v) in head:
            weights[u, v] += brute.weight(b, weight) / math.log(d)
    ends = {r.member_id: (r.last_slot, r.tail) for r in head.values()}
    bound = {p: w + min(ends[p[0]], ends[p[1]])[1] for p, w in weights.items()}
    assert listed == {p for p, w in bound.items() if w >= least - cand.SLACK}
    assert len(listed) < len(met)


@pytest.mark.parametrize("weight", ["flat", "typed"])
@pytest.mark.parametrize("repeated", [False, True])
def test_cells_find_the_same_pairs(spark, monkeypatch, weight, repeated):
    """Several blocks, tiles, and hubs taken at once; pairs that meet in small groups as well."""
    monkeypatch.setattr(cand, "_cells_cost_less", lambda *sizes: True)
    for name, n in [("BLOCK_ROWS", 300), ("TILE", 9), ("HUBS_AT_ONCE", 11), ("LISTED_AT_ONCE", 50)]:
        monkeypatch.setattr(cells, name, n)
    rows = random_members(9)
    if repeated:
        rows += [r for i, r in enumerate(rows) for _ in range(i % 3) if i % 5 == 0]
    table = as_table(spark, rows)
    plain = cand.pair_scores(table, min_score=4.0, weight=weight, hub_degree=1000)
    want = sorted((*r[:2], round(r["score"], 5), *r[3:]) for r in plain.collect())
    assert len(want) > 100
    for hub_degree in (1, 12):
        got = cand.pair_scores(table, min_score=4.0, weight=weight, hub_degree=hub_degree)
        assert sorted((*r[:2], round(r["score"], 5), *r[3:]) for r in got.collect()) == want


def test_many_users_in_all_hubs_are_worked_out_in_cells(spark, monkeypatch):
    """No wedge is listed but those of pairs that reach the cut (18 million meet in hubs)."""
    monkeypatch.setattr(cand, "MANY_WEDGES", 1_000_000)
    listed = lambda *a, **k: pytest.fail("all wedges are listed")
    monkeypatch.setattr(cand, "_block_wedges", listed)
    rng = random.Random(1)
    rows = [(h, u, 4, 0) for u in range(600) for h in rng.sample(range(200), 100)]
    rows += [(h, 600, 4, 0) for h in range(100)] + [(h, 601, 4, 0) for h in range(90)]
    sizes = collections.Counter(r[0] for r in rows)
    rows = [(*r[:3], sizes[r[0]]) for r in rows]
    got = cand.pair_scores(as_table(spark, rows), min_score=13.0, hub_degree=10)
    assert [(r["user1"], r["user2"]) for r in got.collect()] == [(600, 601)]


def packed_piece(rows, weight, number=0):
    """Memberships (mid, user, mask, degree) as a task gets them."""
    main = lambda m: next((b for b in rel.BUCKET_PRIORITY if b in {brute.MAIN[x] for x in brute.MAIN if m & x}), None)
    full = [brute.full(r[2]) for r in rows]
    columns = {
        "piece": pa.array([number] * len(rows), pa.int32()),
        "block": pa.array([number] * len(rows), pa.int32()),
        "mid_id": [r[0] for r in rows],
        "member_id": [r[1] for r in rows],
        "degree": [r[3] for r in rows],
        "mask": pa.array([r[2] for r in rows], pa.int32()),
        "main": pa.array([brute.code(main(r[2])) for r in rows], pa.int32()),
        "full": pa.array([sum(rel.BUCKETS[b] for b in f) for f in full], pa.int32()),
        "root": [math.sqrt(max([brute.weight(b, weight) for b in f], default=1.0)) for f in full],
    }
    return cells._pack(pa.table(columns))


@pytest.mark.parametrize("weight", ["flat", "typed"])
@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("table_size, share", [(0, 0.0), (1 << 24, 0.0), (1 << 24, 0.2)])
def test_tiles_are_left_early_without_loss(monkeypatch, weight, repeated, table_size, share):
    """Many tiles and steps of the product, in the process of the test."""
    for name, n in [("TILE", 9), ("HUBS_AT_ONCE", 5), ("LISTED_AT_ONCE", 50), ("SENT_AT_ONCE", 7)]:
        monkeypatch.setattr(cells, name, n)
    monkeypatch.setattr(cells, "TABLE_SIZE", table_size)
    monkeypatch.setattr(cells, "LISTED_SHARE", share)
    rows = random_members(10)
    if repeated:
        rows += [r for i, r in enumerate(rows) for _ in range(i % 3) if i % 5 == 0]
    degree = {r[0]: r[3] for r in rows}
    want = collections.defaultdict(float)
    counts = collections.defaultdict(collections.Counter)
    for m, group in itertools.groupby(sorted(rows), lambda r: r[0]):
        for (_, u, x, _), (_, v, y, _) in itertools.combinations(list(group), 2):
            if u != v:
                bucket = brute.combine(x, y)
                want[u, v] += brute.weight(bucket, weight) / math.log(degree[m])
                counts[u, v][bucket] += 1
    pieces = [
        cells._unpack(packed_piece([r for r in rows if r[1] % 3 == k], weight).to_pylist()[0])
        for k in range(3)
    ]
    cut = sorted(want.values())[len(want) // 2]
    work = cells._Cell(cut, weight)
    hubs = cells._Hubs.of(pieces[:2])
    held = cells._Side(pieces[:2], hubs)
    found = [r for b in work.pairs(held, held, hubs) for r in b.to_pylist()]
    found += [r for b in work.pairs(held, cells._Side(pieces[2:], hubs), hubs) for r in b.to_pylist()]
    rest = cells._Hubs.of(pieces[2:])
    alone = cells._Side(pieces[2:], rest)
    found += [r for b in work.pairs(alone, alone, rest) for r in b.to_pylist()]
    got = {(r["user1"], r["user2"]): r for r in found}
    assert len(got) == len(found) and {p for p, s in want.items() if s >= cut} <= got.keys()
    for pair, r in got.items():
        assert r["score"] == pytest.approx(want[pair]) and r["score"] >= cut * 0.999
        assert {b: n for b in rel.BUCKETS if (n := r[rel.count_name(b)])} == {
            b: n for b, n in counts[pair].items() if b
        }


def test_memberships_travel_in_a_few_bytes():
    """Not in one row of many megabytes, which every block sends to all others."""
    rng = random.Random(2)
    rows = [(h, u, rng.choice([0, 4, 1024]), 900) for u in range(1_000) for h in rng.sample(range(200), 50)]
    row = packed_piece(rows, "flat").to_pylist()[0]
    sent = sum(len(x) for x in row.values() if isinstance(x, bytes))
    assert sent < 3 * len(rows)


def test_near_pairs_leave_as_one_row_in_pieces(spark, monkeypatch):
    """However much two users share, and although their block comes in several rows."""
    monkeypatch.setattr(cells, "PIECE_ROWS", 100)
    rows = [(hub, user, 4, 30) for hub in range(40) for user in range(30)]
    found = cells.near_pairs(as_table(spark, rows), len(rows), 30, 5.0).collect()
    assert len(found) == len({(r.user1, r.user2) for r in found}) == 435
    assert all(r.n_close_family == 40 and r.score == pytest.approx(40 / math.log(30)) for r in found)


def test_counts_stop_at_7(spark):
    rows = [(mid, user, 1024, 2) for mid in range(9) for user in (1, 2)]
    r = cand.pair_scores(as_table(spark, rows)).first()
    assert r["n_school"] == 7
    assert r["packed"] == 7 << rel.COUNTER_OFFSETS["SCHOOL"]


def test_close_family_can_be_left_uncounted(spark):
    rows = [(mid, user, 4, 2) for mid in range(3) for user in (1, 2)]
    members = as_table(spark, rows)
    assert cand.pair_scores(members).first()["n_close_family"] == 3
    plain = cand.pair_scores(members, count_close_family=False).first()
    assert (plain["n_close_family"], plain["packed"]) == (0, 0)


def test_wedges_and_their_counts(spark):
    rows = random_members(6)
    members = as_table(spark, rows)
    want = sorted((u, v, m, d, brute.code(b)) for u, v, m, d, b in brute.wedges([r[:3] for r in rows]))
    assert sorted(map(tuple, cand.wedges(members).collect())) == want
    counted = {}
    for _, _, _, degree, bucket in want:
        counted[degree, bucket] = counted.get((degree, bucket), 0) + 1
    got = {(r["degree"], r["bucket"]): r["n_wedges"] for r in cand.wedge_counts(members).collect()}
    assert got == counted


def test_wedges_of_given_pairs(spark):
    rows = random_members(7)
    members = as_table(spark, rows)
    keys = stored(cand.pair_scores(members, min_score=4.0).select("user1", "user2"), "keys")
    kept = {tuple(r) for r in keys.collect()}
    want = [(u, v, m, d, brute.code(b)) for u, v, m, d, b in brute.wedges([r[:3] for r in rows])]
    got = cand.wedges_of_pairs(keys, members).drop("weight").collect()
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[:2] in kept)


@pytest.mark.parametrize("hub_degree", [12, 1000])
def test_wedges_of_many_pairs_are_not_looked_up_user_by_user(spark, monkeypatch, hub_degree):
    """Small groups are listed once, whichever way round pairs are given."""
    rows = random_members(7)
    rows += [r for i, r in enumerate(rows) for _ in range(i % 3) if i % 5 == 0]
    members = as_table(spark, rows)
    pairs = cand.pair_scores(members, min_score=1.0).selectExpr("user2 AS user1", "user1 AS user2")
    keys = stored(pairs, "keys")
    want = cand._wedges_of(keys, members).collect()
    looked_up, look_up = [], cand._wedges_of
    monkeypatch.setattr(
        cand, "_wedges_of", lambda k, m: looked_up.append(m.count()) or look_up(k, m)
    )
    got = cand.wedges_of_pairs(keys, members, hub_degree=hub_degree)
    assert looked_up == [sum(r[3] > hub_degree for r in rows)] and len(want) > 1000
    got = got.select("user1", "user2", "mid_id", "degree", "bucket").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_counts_share_longs_on_the_way(spark):
    """Two counts in a long: a row that leaves a task has four longs, not eight."""
    rows = [(mid, user, mask, 3) for mid, mask in enumerate([4, 1024, 512, 0, 256, 1 << 20] * 3)
            for user in (1, 2, 3)]
    reduced = cand._reduce(cand.wedges(as_table(spark, rows)), "flat")
    assert str(reduced._jdf.queryExecution().executedPlan()).count("partial_sum") == 5
    want = brute.pairs([r[:3] for r in rows], 0.0)
    got = {(r["user1"], r["user2"]): tuple(r[c] for c in rel.COUNT_COLUMNS) for r in reduced.collect()}
    assert got == {pair: counts for pair, (_, counts) in want.items()}


def test_groups_are_joined_where_they_lie(spark):
    """The self-join shuffles each side once, by group, and nothing more."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = cand.wedges(as_table(spark, random_members(8)), tasks=12)
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(mid_id") == 2
    assert text.count("Exchange") == 2
    assert text.count(", 12)") == 2 or text.count(", 12),") == 2


# -- graph and joins -------------------------------------------------------


def test_active_owners(spark):
    edges = spark.createDataFrame(
        [(1, 2, 4), (2, 1, 4), (2, 3, 4), (3, 1, 4), (3, 2, 4), (3, 4, 4)], EDGES
    )
    for least, owners in [(2, {2, 3}), (3, {3}), (1, {1, 2, 3})]:
        rows = graph.active_owner_edges(edges, least).collect()
        assert {r["user_id"] for r in rows} == owners
        assert len(rows) == {2: 5, 3: 3, 1: 6}[least]


def test_group_members(spark):
    edges = spark.createDataFrame(
        [(1, 9, 16), (1, 8, 4), (2, 9, 8), (2, 7, 4), (3, 9, 4)], EDGES
    )
    rows = sorted(map(tuple, graph.group_members(edges).collect()))
    assert rows == [(9, 1, 8, 2), (9, 2, 8, 2)]


def test_lone_edges_are_found_once(spark):
    rows = [(1, 2, 4), (1, 3, 4), (2, 3, 8), (3, 1, 2), (3, 2, 2), (4, 2, 1), (4, None, 1), (None, 2, 1)]
    edges = stored(spark.createDataFrame(rows, "user_id long, friend_id long, mask int"), "edges")
    found = graph.group_members(edges, n_edges=edges.count())
    assert sorted(map(str, found.collect())) == sorted(map(str, graph.group_members(edges).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Only group sizes are left to work out, and so few lone edges need no shuffle of the edges.
    assert plan.count("Aggregate [user_id") == 0
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString().split("LeftAnti")[0]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("total", [None, 1000])
def test_salted_join_equals_plain_join(spark, monkeypatch, how, total):
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_SHARE", 20)
    facts = spark.range(1000).selectExpr("if(id % 3 = 0, 1, id % 100) AS k", "id AS v")
    other = spark.range(50).selectExpr("id AS k", "id * 10 AS w")
    hot = hot_keys(count_rows(facts, "k"), "k", total=total)
    assert [tuple(r) for r in hot.collect()] == [(1, 7)]  # 341 rows, 50 per salt
    got = salted_join(facts, other, ["k"], hot, ["v"], how)
    want = facts.join(other, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_small_tables_are_joined_plainly(spark):
    counts = count_rows(spark.range(10).withColumnRenamed("id", "k"), "k")
    assert hot_keys(counts, "k", total=10) is None


@pytest.mark.parametrize("per_task", [5_000_000, 40])
@pytest.mark.parametrize("mode", ["flat", "typed"])
def test_few_hubs_meet_as_arrays(spark, monkeypatch, mode, per_task):
    """Users in few hubs, some repeated; none of them, or many, are busy."""
    monkeypatch.setattr(cand, "WEDGES_PER_TASK", per_task)
    monkeypatch.setattr(cand, "HOT_SHARE", 1_000)
    looked_up = []
    plainly = cand._wedges_of
    monkeypatch.setattr(cand, "_wedges_of", lambda *a: looked_up.append(1) or plainly(*a))
    rng = random.Random(8)
    rows = [r[:3] for r in random_members(8, users=40, hubs=0)]
    for user in range(40):
        rows += [(hub, user, rng.choice([0, 256])) for hub in range(3) if rng.random() < 0.8]
    rows += [r for r in rows if r[0] == 0 and r[1] % 9 == 0]
    size = collections.Counter(mid for mid, _, _ in rows)
    rows = [(m, u, t, size[m]) for m, u, t in rows]
    assert min(size[h] for h in range(3)) > 20 > max(n for m, n in size.items() if m > 2)
    cut = 2.0  # more than anyone has in hubs alone
    got = cand.pair_scores(as_table(spark, rows), min_score=cut, weight=mode, hub_degree=20)
    found = {
        (r["user1"], r["user2"]): (r["score"], tuple(r[c] for c in rel.COUNT_COLUMNS))
        for r in got.collect()
    }
    want = {
        k: v for k, v in brute.pairs([r[:3] for r in rows], cut, mode).items() if k[0] != k[1]
    }
    assert len(want) > 20 and found.keys() == want.keys()
    for k, (score, counts) in want.items():
        assert found[k][0] == pytest.approx(score, abs=1e-6) and found[k][1] == counts
    assert bool(looked_up) == (per_task == 40)


def test_wedges_are_listed_after_the_shuffle(spark):
    """Two shuffles, of members and of groups' rests: no wedge is a row of either."""
    plan = cand._small_sums(as_table(spark, random_members(6)), 4, "flat")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2
    assert text.index("HashAggregate") < text.index("posexplode") < text.index("Exchange hash")


def test_missing_masks_and_ids_count_as_they_did(spark):
    rows = [(1, 1, None, 3), (1, 2, 4, 3), (1, None, 4, 3), (None, 1, 4, 2), (None, 2, 4, 2)]
    (pair,) = cand.pair_totals(as_table(spark, rows), min_score=0.5).collect()
    assert (pair["user1"], pair["user2"]) == (1, 2)
    assert pair["score"] == pytest.approx(1 / math.log(3), abs=1e-6)
    assert all(pair[c] == 0 for c in rel.COUNT_COLUMNS)
