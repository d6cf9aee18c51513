import math

import pytest

from linkrec.functions import ids, profiles as pf
from linkrec.operators import features, labels, skew
from linkrec.storage import stored

EDGES = "user_id long, friend_id long, mask int"


def pairs_of(spark, *rows):
    return spark.createDataFrame(rows, "user1 long, user2 long")


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first()["v"]


def test_labels(spark):
    edges = spark.createDataFrame([(1, 2, 0), (3, 1, 0), (1, 9, 0), (2, 3, 4)], EDGES)
    positives = {tuple(r) for r in labels.positive_pairs(edges).collect()}
    assert positives == {(1, 2, 1.0), (2, 3, 1.0)}
    pairs = pairs_of(spark, (1, 2), (1, 3), (2, 3))
    labeled = labels.label_pairs(pairs, edges)
    assert {tuple(r) for r in labeled.collect()} == {(1, 2, 1.0), (1, 3, 0.0), (2, 3, 1.0)}
    strangers = [(r["user1"], r["user2"]) for r in labels.without_friends(labeled).collect()]
    assert strangers == [tuple(r) for r in labels.non_friends(pairs, edges).collect()] == [(1, 3)]


def test_holdout_and_train_pairs_make_up_all(spark):
    pairs = spark.range(200).selectExpr("id AS user1", "id * 3 AS user2")
    train, test = labels.train_pairs(pairs), labels.test_pairs(pairs)
    assert train.count() + test.count() == 200
    assert all(r["user1"] % 11 != 7 and r["user2"] % 11 != 7 for r in train.collect())
    assert value(spark, ids.is_holdout("-4")) is True


def test_split_is_stable_and_near_its_weights(spark):
    pairs = spark.range(20000).selectExpr("id % 150 AS user1", "id AS user2")
    one = labels.with_split(pairs)
    two = labels.with_split(pairs.repartition(13))
    assert one.exceptAll(two).count() == 0
    sizes = {r["split"]: r["count"] for r in one.groupBy("split").count().collect()}
    for number, share in enumerate(labels.SPLIT_WEIGHTS):
        assert sizes[number] / 20000 == pytest.approx(share, abs=0.02)
    other = labels.with_split(pairs, seed=12)
    assert one.exceptAll(other).count() > 0
    assert sum(p.count() for p in labels.random_splits(pairs)) == 20000


def test_split_of_huge_ids_does_not_overflow(spark):
    big = 2**63 - 1
    assert 0 <= value(spark, ids.split_hash(str(big), str(big - 1))) < ids.SPLIT_RANGE


@pytest.mark.parametrize("days, years", [(364, 0), (365, 1), (-400, -1), (-364, 0), (0, 0)])
def test_whole_years(spark, days, years):
    assert value(spark, pf.whole_years(f"({days})")) == years


@pytest.mark.parametrize(
    "one, two, code",
    [(0, 1, -1), (1, 0, -1), (1, 1, 1), (2, 2, 2), (1, 2, 3), (2, 1, 4)],
)
def test_sex_code(spark, one, two, code):
    assert value(spark, pf.sex_code(str(one), str(two))) == code


def test_created_close(spark):
    week = 7 * 86400000
    assert value(spark, pf.created_close("0L", f"{week}L")) == 1
    assert value(spark, pf.created_close(f"{week + 1}L", "0L")) == 0


def test_log_age(spark):
    assert value(spark, pf.log_age("0L")) == pytest.approx(math.log(pf.REFERENCE_MS))
    assert value(spark, pf.log_age(f"{pf.REFERENCE_MS}L")) == 0.0
    assert value(spark, pf.log_age(f"{pf.REFERENCE_MS + 5}L")) == 0.0
    parity = value(spark, pf.log_age("0L", pf.REFERENCE_MS_PARITY))
    assert parity == pytest.approx(math.log(pf.REFERENCE_MS_PARITY))


def test_same_place(spark):
    cases = {("0", "0"): -1, ("0", "3"): -1, ("3", "3"): 1, ("3", "4"): 0}
    assert {c: value(spark, pf.same_place(*c)) for c in cases} == cases


def test_features_of_users_without_profile(spark):
    profiles = spark.createDataFrame(
        [(1, 1000, 800, 1, 3, 4, 5)],
        "user_id long, create_ms long, age_days int, sex int, country long, location long,"
        " login_region long",
    )
    pairs = pairs_of(spark, (1, 2), (1, 1), (3, 1)).selectExpr("*", f"{5 << 9} AS packed")
    wide = features.with_features(pairs, profiles)
    rows = {(r["user1"], r["user2"]): r for r in wide.collect()}
    r = rows[1, 2]
    assert [r[c] for c in features.PROFILE_FEATURES[:4]] == [2, 2, -1, 1]
    assert [r[c] for c in features.PROFILE_FEATURES[5:]] == [-1, -1, -1]
    assert rows[3, 1]["years_gap"] == -2
    assert [rows[3, 1][c] for c in ("n_school", "n_family")] == [5, 0]
    assert [rows[1, 1][c] for c in features.PROFILE_FEATURES[5:]] == [1, 1, 1]
    assert len(features.PROFILE_FEATURES) == len(features.RELATION_FEATURES) == 8


def test_hot_users_do_not_change_labels_or_features(spark, monkeypatch):
    edges = spark.range(400).selectExpr(
        "if(id < 300, id % 90, id) AS user_id", "if(id < 300, 95L, id % 50) AS friend_id", "4 AS mask"
    )
    edges = stored(edges.where("user_id <> friend_id").union(
        spark.createDataFrame([(95, 96, 4), (96, 95, 4)], EDGES)).distinct(), "edges")
    profiles = stored(spark.range(60).selectExpr(
        "id AS user_id", "id * 86400000 AS create_ms", "int(id * 100) AS age_days",
        "int(id % 3) AS sex", "id % 4 AS country", "id % 5 AS location", "id % 6 AS login_region",
    ), "profiles")
    pairs = stored(spark.range(300).selectExpr(
        "if(id < 200, 3L, id % 40) AS user1", "id + 41 AS user2", "int(id) AS packed"), "pairs")

    def answers():
        frames = [labels.positive_pairs(edges), features.with_features(pairs, profiles)]
        return [
            sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect()) for df in frames
        ]

    plain = answers()
    assert [len(rows) > 0 for rows in plain] == [True, True]
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_SHARE", 20)
    assert answers() == plain
