"""From files of lines to files of lines, and the settings of the whole run."""

import gzip
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkrec.operators import graph
from linkrec.operators.evaluate import best_threshold, fbeta_curve
from linkrec.operators.labels import train_pairs
from linkrec.operators.models import STACKED, fit_stacked
from linkrec.plans import catalog, recommendation
from linkrec.sources import fixtures
from linkrec.storage import shared_folder

DIR = "/root/testdata/sf0.001"
K = 3
SETTINGS = replace(catalog.SETTINGS, k=K)


def stored_folders(spark):
    root = Path(shared_folder(spark).removeprefix("file:")) / "linkrec"
    return {p.name for p in root.iterdir()} if root.exists() else set()


def test_text_to_text(spark, tmp_path):
    edges = fixtures.edges(spark, DIR).cache()
    ranked = recommendation.recommend(edges, fixtures.all_profiles(spark, DIR), SETTINGS).collect()
    want = {}
    for r in sorted(ranked, key=lambda r: (r.user_id, r["rank"])):
        want.setdefault(r.user_id, [r.user_id]).append(r.friend_id)
    assert want
    lists, profiles, out = (str(tmp_path / n) for n in ("lists", "profiles", "out"))
    bad = spark.createDataFrame([("no list",)], "value string")
    fixtures.adjacency_text(spark, DIR).union(bad).write.text(lists)
    fixtures.profile_text(spark, DIR).write.text(profiles)
    before = stored_folders(spark)
    with pytest.raises(Exception, match="cannot read line"):
        recommendation.recommend_text(spark, lists, profiles, out, SETTINGS)
    recommendation.recommend_text(spark, lists, profiles, out, SETTINGS, on_bad="skip")
    assert stored_folders(spark) == before
    lines = []
    for file in sorted(Path(out).glob("*.txt.gz")):
        lines += gzip.open(file, "rt").read().splitlines()
    assert [[int(x) for x in line.split("\t")] for line in lines] == [want[u] for u in sorted(want)]
    friends = {(r.user_id, r.friend_id) for r in edges.collect()}
    owners = {u for u, _ in friends}
    for u, *rest in want.values():
        # Known friends: the smaller id lists the other, and both have lists.
        assert not any(f in owners and (min(u, f), max(u, f)) in friends for f in rest)
    edges.unpersist()


def test_settings_reach_their_steps(spark, tmp_path):
    edges = fixtures.edges(spark, DIR).cache()
    lists = edges.groupBy("user_id").count()
    owners = lists.where("count >= 25").select("user_id")
    by_hand = edges.join(owners, "user_id", "left_semi")
    sizes = sorted(r["count"] for r in by_hand.groupBy("friend_id").count().collect())
    middle = sizes[len(sizes) // 2] + 1
    least = replace(SETTINGS, min_friends=25, min_degree=middle, folder=str(tmp_path))
    got = recommendation.candidate_pairs(edges, least)
    few = recommendation.candidate_pairs(edges, replace(least, min_degree=2))  # not the kept ones
    pairs = lambda df: {(r.user1, r.user2) for r in df.select("user1", "user2").collect()}
    members = graph.group_members(by_hand, 1, middle).collect()
    groups = {}
    for m in members:
        groups.setdefault(m.mid_id, set()).add(m.member_id)
    shared = lambda a, b: any({a, b} <= g for g in groups.values())
    assert 0 < len(pairs(got)) < len(pairs(few)) and pairs(got) <= pairs(few)
    assert all(len(g) >= middle for g in groups.values()) and all(shared(*p) for p in pairs(got))

    people = fixtures.all_profiles(spark, DIR)
    other = replace(SETTINGS, split_weights=[0.5, 0.25, 0.25], split_seed=3)
    wide = recommendation.wide_pairs(edges, people, other)
    n = {r.split: r["count"] for r in wide.groupBy("split").count().collect()}
    assert abs(n[0] / sum(n.values()) - 0.5) < 0.05 and abs(n[2] / sum(n.values()) - 0.25) < 0.05
    model = fit_stacked(train_pairs(wide))
    scored = model.transform(train_pairs(wide).where(F.col("split") == 2))
    chosen = {}
    for beta in (0.1, 8.0):
        best = recommendation.validate(model, wide, beta=beta).first()
        assert best.threshold == best_threshold(fbeta_curve(scored, STACKED, beta)).first().threshold
        chosen[beta] = best.threshold
    assert chosen[0.1] > chosen[8.0]
    edges.unpersist()


def lines_of(folder):
    files = sorted(Path(folder).glob("part-*.txt*"))
    read = lambda f: (gzip.open if f.suffix == ".gz" else open)(f, "rt").read()
    return [line for f in files for line in read(f).splitlines()]


def test_a_killed_run_goes_on_from_its_last_table(spark, tmp_path, monkeypatch):
    lists, profiles, whole, out, keep, bad = (
        str(tmp_path / n) for n in ("lists", "profiles", "whole", "out", "keep", "bad")
    )
    noise = spark.createDataFrame([("no list",)], "value string")
    fixtures.adjacency_text(spark, DIR).union(noise).write.text(lists)
    fixtures.profile_text(spark, DIR).write.text(profiles)
    recommendation.recommend_text(spark, lists, profiles, whole, SETTINGS, on_bad="skip")
    safe = replace(SETTINGS, folder=keep)

    def stop(*_, **__):
        raise RuntimeError("killed")

    def written():
        return {p: p.stat().st_mtime_ns for p in Path(keep).rglob("*.parquet") if p.is_file()}

    def go(target, settings=safe):
        recommendation.recommend_text(
            spark, lists, profiles, target, settings, on_bad="skip", rejected=bad
        )

    with monkeypatch.context() as m:
        m.setattr(recommendation, "pair_scores", stop)
        with pytest.raises(RuntimeError, match="killed"):
            go(out)
    first = written()
    names = {p.relative_to(keep).parts[0].split("-")[0] for p in first}
    assert names == {"inputs", "lists", "people", "edges", "profiles", "members"}
    with monkeypatch.context() as m:
        m.setattr(recommendation, "group_members", stop)
        m.setattr(recommendation, "fit_stacked", stop)
        with pytest.raises(RuntimeError, match="killed"):
            go(out)
    second = written()
    assert first.items() < second.items()  # none is written again
    with monkeypatch.context() as m:
        m.setattr(recommendation, "pair_scores", stop)
        m.setattr(recommendation, "with_features", stop)
        go(out)
        assert lines_of(out) == lines_of(whole) and written() == second
        assert lines_of(f"{bad}/lists") == ["no list"] and lines_of(f"{bad}/profiles") == []
        # Other settings and other files get tables of their own.
        with pytest.raises(RuntimeError, match="killed"):
            go(str(tmp_path / "other"), replace(safe, split_seed=5))
        with pytest.raises(RuntimeError, match="killed"):
            go(str(tmp_path / "other"), replace(safe, min_score=2.0))
        (Path(profiles) / "more.txt").write_text("1\t5\n")
        with pytest.raises(RuntimeError, match="killed"):
            go(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="skip"):
        recommendation.recommend_text(spark, lists, profiles, out, safe, rejected=bad)
