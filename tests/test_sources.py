import gzip
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from linkrec.operators import graph
from linkrec.schemas import PROFILES
from linkrec.sources import stores, text
from linkrec.storage import shared_folder, stored, write_once


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_adjacency_lines(spark):
    df = text.parse_adjacency(lines(spark, "7\t{(8,17),(9,0),(3,2048)}", "5\t{(1,4)}\textra"))
    rows = {r["user_id"]: [tuple(f) for f in r["friends"]] for r in df.collect()}
    assert rows == {7: [(8, 16), (9, 0), (3, 2048)], 5: [(1, 4)]}


@pytest.mark.parametrize(
    "bad", ["7\t{}", "7", "", "x\t{(1,2)}", "7\t{(1,x)}", "7\t{(1)}", "7\t{(1,2),}"]
)
def test_bad_adjacency_lines_are_returned(spark, bad):
    df = lines(spark, bad, "7\t{(8,16)}")
    seen = Observation()
    assert text.parse_adjacency(df, "skip", seen).count() == 1
    assert seen.get["rejected"] == 1
    with pytest.raises(Exception, match="cannot read line"):
        text.parse_adjacency(df).count()
    assert [r["value"] for r in text.rejected_adjacency(df).collect()] == [bad]


def test_read_adjacency_from_files(spark, tmp_path):
    (tmp_path / "a").write_text("1\t{(2,5)}\n2\t{(1,4),(3,8)}\n")
    edges = graph.flatten(text.read_adjacency(spark, str(tmp_path)))
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 4), (2, 1, 4), (2, 3, 8)]


def test_repeated_entries(spark):
    df = text.parse_adjacency(lines(spark, "1\t{(2,4),(2,8)}"))
    assert [tuple(r) for r in graph.flatten(df).collect()] == [(1, 2, 12)]
    assert graph.flatten(df, "keep").count() == 2


def test_profile_lines(spark):
    good = lines(spark, "1\t100\t-400\t2\t3\t4\t5", "2", "3\t\t50\t\t", "  4\t9")
    rows = {r["user_id"]: tuple(r) for r in text.parse_profiles(good).collect()}
    assert rows == {
        1: (1, 100, -400, 2, 3, 4, 5),
        2: (2, 0, 0, 0, 0, 0, 0),
        3: (3, 0, 50, 0, 0, 0, 0),
        4: (4, 9, 0, 0, 0, 0, 0),
    }


@pytest.mark.parametrize("bad", ["", "   ", "\t5", "x\t1", "5\tsoon"])
def test_bad_profile_lines_are_returned(spark, bad):
    df = lines(spark, bad, "1\t2")
    assert text.parse_profiles(df, "skip").count() == 1
    with pytest.raises(Exception, match="cannot read line"):
        text.parse_profiles(df).count()
    assert [r["value"] for r in text.rejected_profiles(df).collect()] == [bad]


def test_last_profile_line_wins(spark, tmp_path):
    (tmp_path / "a").write_text("1\t10\n2\t20\n1\t11\n")
    (tmp_path / "b").write_text("2\t21\n1\t12\n1\t13\n")
    latest = text.latest_profiles(text.read_profiles(spark, str(tmp_path)), "line_order")
    assert {r["user_id"]: r["create_ms"] for r in latest.collect()} == {1: 13, 2: 21}
    assert latest.columns == PROFILES.fieldNames()


def test_recommendation_files(spark, tmp_path):
    lists = spark.createDataFrame([(9, [3, 1]), (2, [5])], "user_id long, friends array<long>")
    path = tmp_path / "out"
    text.write_recommendations(lists, str(path), single_file=True)
    files = list(Path(path).glob("*.gz"))
    assert len(files) == 1
    assert gzip.decompress(files[0].read_bytes()).decode() == "2\t5\n9\t3\t1\n"


def test_write_once_skips_whole_tables_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write_once(spark.range(3), path)
    assert not write_once(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert write_once(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_stored_tables_go_to_the_session_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    df = stored(spark.range(4), "numbers")
    assert folder in df.inputFiles()[0]
    assert df.count() == 4


def test_pair_store_prunes_slices(spark, tmp_path):
    path = str(tmp_path / "pairs")
    pairs = spark.range(500).select(F.col("id").alias("user1"), (F.col("id") + 1).alias("user2"))
    assert stores.write_pairs(pairs, path, slices=7)
    back = stores.read_pairs(spark, path)
    assert back.count() == 500
    one = back.where("slice = 3")
    assert {r["user1"] % 7 for r in one.collect()} == {3}
    assert "PartitionFilters: [isnotnull(slice" in one._jdf.queryExecution().toString()


def test_group_store(spark, tmp_path):
    members = spark.createDataFrame(
        [(1, m, 4, 25) for m in range(25)], "mid_id long, member_id long, mask int, degree long"
    )
    path = str(tmp_path / "groups")
    stores.write_groups(graph.group_lists(members, list_size=10), path)
    groups = stores.read_groups(spark, path)
    rows = groups.collect()
    lists = [[m["member_id"] for m in r["members"]] for r in sorted(rows, key=lambda r: r["chunk"])]
    assert [len(x) for x in lists] == [10, 10, 5]
    assert sum(lists, []) == list(range(25))
    assert graph.explode_groups(groups).exceptAll(members).count() == 0
    assert graph.explode_groups(groups).count() == 25


def test_both_kinds_of_lines_come_from_one_pass(spark, tmp_path):
    source = tmp_path / "lines"
    source.write_text("7\t{(8,17),(9,0)}\nx\t{(1,2)}\n\n5\t{(1,4)}\n")
    lists, rejected = text.sorted_adjacency(spark.read.text(str(source)))
    source.unlink()  # nothing is read again
    rows = {r["user_id"]: [tuple(f) for f in r["friends"]] for r in lists.collect()}
    assert rows == {7: [(8, 16), (9, 0)], 5: [(1, 4)]}
    assert sorted(r["value"] for r in rejected.collect()) == ["", "x\t{(1,2)}"]

    source.write_text("3\t5\n\t9\n3\tsoon\n3\t6\n")
    people, bad = text.sorted_profiles(text.profile_lines(spark, str(source)))
    source.unlink()
    assert people.columns == ["line_order", *PROFILES.fieldNames()]
    assert [r["create_ms"] for r in text.latest_profiles(people, "line_order").collect()] == [6]
    assert sorted(r["value"] for r in bad.collect()) == ["\t9", "3\tsoon"]

    none = lines(spark, "7\t{(8,16)}").limit(0)
    assert [df.count() for df in text.sorted_adjacency(none)] == [0, 0]
    spoilt = lines(spark, None, "bad")
    assert [df.count() for df in text.sorted_adjacency(spoilt)] == [0, 2]
    assert [df.count() for df in text.sorted_profiles(spoilt)] == [0, 2]
