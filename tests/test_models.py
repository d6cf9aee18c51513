from dataclasses import replace

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from linkrec.functions.ids import HOLDOUT_MODULUS, HOLDOUT_REMAINDER
from linkrec.operators import evaluate, features, labels, models
from linkrec.operators.recommend import both_directions, suggestion_lists, top_k
from linkrec.plans import catalog, recommendation
from linkrec.sources import fixtures
from linkrec.storage import stored

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def edges(spark):
    return stored(fixtures.edges(spark, DIR), "edges")


@pytest.fixture(scope="module")
def wide(spark, edges):
    return recommendation.wide_pairs(edges, fixtures.all_profiles(spark, DIR), catalog.SETTINGS)


@pytest.fixture(scope="module")
def stacked(wide):
    return models.fit_stacked(labels.train_pairs(wide))


def test_logistic_score_ranks_like_its_one_feature(wide):
    base = wide.where(F.col("split") == labels.BASE)
    model = models.fit(base, features.SCORE_FEATURES, models.logistic_regression())
    scored = stored(models.add_score(model, wide, "p").select("label", "score", "p"), "scored")
    weight = model.stages[-1].coefficients[0]
    assert model.stages[-1].intercept == 0.0
    raw, own = (
        BinaryClassificationEvaluator(rawPredictionCol=c, numBins=0).evaluate(scored)
        for c in ("score", "p")
    )
    assert own == pytest.approx(raw if weight > 0 else 1 - raw)
    sigmoid = 1 / (1 + F.exp(-weight * F.col("score")))
    assert scored.where(F.abs(F.col("p") - sigmoid) > 1e-9).count() == 0


def test_tree_has_no_small_leaf_and_is_repeatable(wide):
    base = wide.where(F.col("split") == labels.BASE)
    columns = features.PROFILE_FEATURES
    scored = []
    for _ in range(2):
        model = models.fit(base, columns, models.decision_tree())
        scored.append(models.add_score(model, base, "p").select("user1", "user2", "p"))
    tree = model.stages[-1].stages[-1]
    assert tree.numNodes > 1
    assert scored[0].where("p < 0 or p > 1").count() == 0
    assert scored[0].exceptAll(scored[1]).count() == 0
    assert scored[0].groupBy("p").count().where("count < 50").count() == 0


def test_leaf_share_bounds_the_tree(wide):
    base = wide.where(F.col("split") == labels.BASE)
    sizes = [
        models.fit(base, features.PROFILE_FEATURES, models.decision_tree(share)).stages[-1]
        .stages[-1].numNodes
        for share in (0.0, 0.1)
    ]
    assert sizes[1] < sizes[0]
    assert sizes[1] <= 19


def test_tree_of_one_class_gives_two_probabilities(spark):
    rows = spark.createDataFrame([(0.0, float(i)) for i in range(120)], "label double, x double")
    model = models.fit(rows, ["x"], models.decision_tree())
    assert {r["p"] for r in models.add_score(model, rows, "p").collect()} == {0.0}


def test_tree_scores_values_it_has_not_seen(spark):
    rows = spark.createDataFrame(
        [(float(i % 2), float(i % 2)) for i in range(200)], "label double, x double"
    )
    model = models.fit(rows, ["x"], models.decision_tree())
    new = spark.createDataFrame([(0.0, 7.0)], "label double, x double")
    assert 0.0 <= models.add_score(model, new, "p").first()["p"] <= 1.0


def test_stacked_scores_cover_every_pair_once(wide, stacked):
    held = wide.where(F.col("split") == labels.VALIDATION)
    scored = stacked.transform(held)
    assert scored.count() == held.count() == scored.select("user1", "user2").distinct().count()
    for c in [*models.STACKED_SCORES, models.STACKED]:
        assert scored.where(f"{c} is null or {c} < 0 or {c} > 1").count() == 0


def test_strategy_can_be_changed(wide):
    base = models.fit_base(wide, {"type": models.logistic_regression})
    assert len(base["type"].stages[-1].coefficients) == 8


def test_finished_tables_are_used_again(spark, edges, tmp_path):
    settings = recommendation.Settings(hub_degree=100, folder=str(tmp_path))
    first = recommendation.candidate_pairs(edges, settings)
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("*/*.parquet")}
    written = files()
    assert {p.parent.name.split("-")[0] for p in written} == {"members", "pairs"}
    again = recommendation.candidate_pairs(edges.orderBy("friend_id"), settings)
    assert again.count() == first.count() > 0 and files() == written
    for done in tmp_path.glob("pairs*/_SUCCESS"):
        done.unlink()
    recommendation.candidate_pairs(edges, settings)
    later = files()
    assert all((p in later) == p.parent.name.startswith("members") for p in written)


@pytest.mark.parametrize("change", [{"weight": "typed"}, {"min_score": 3.0}, {"inversion": "swap"}])
def test_kept_tables_are_never_stale(edges, tmp_path, change):
    kept = recommendation.Settings(folder=str(tmp_path))
    recommendation.candidate_pairs(edges, kept)
    for other in (edges, edges.where("user_id % 2 = 0")):
        fresh = recommendation.candidate_pairs(other, recommendation.Settings(**change))
        again = recommendation.candidate_pairs(other, replace(kept, **change))
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fresh.collect()))


def test_a_leaf_budget_bounds_the_tree_on_all_rows(wide):
    base = stored(wide.where(F.col("split") == labels.BASE), "base")
    columns = features.PROFILE_FEATURES
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    rows = models.with_label_values(base.select("label", *columns))
    plain = Pipeline(stages=[assembler, models.decision_tree()]).fit(rows)
    shape = lambda m: m.stages[-1].stages[-1].toDebugString.split("\n", 1)[1]
    # Where the budget does not bind it is the tree that Spark grows by itself.
    assert shape(models.fit(base, columns, models.decision_tree())) == shape(plain)
    leaves = (plain.stages[-1].stages[-1].numNodes + 1) // 2
    for budget in (1, 4, leaves // 2):
        small = models.fit(base, columns, models.decision_tree(), budget)
        tree = small.stages[-1].stages[-1]
        assert 1 <= (tree.numNodes + 1) // 2 <= budget
        root = models.tree_nodes(small).where("id = 0").first()
        assert root.n0 + root.n1 == base.count()
    free = models.fit(base, columns, models.decision_tree(), None)
    assert shape(free) == shape(plain)


def test_a_leaf_needs_no_more_rows_where_there_are_many(spark):
    """55 of 2.4 million rows are told apart like 55 of 2,400."""
    for n_rows in (2_400, 2_400_000):
        rows = spark.range(n_rows).selectExpr("double(id < 55) AS label", "double(id < 55) AS x")
        model = models.fit(rows, ["x"], models.decision_tree())
        leaves = models.tree_nodes(model).where("feature is null").orderBy("n1").collect()
        assert [(r.n0, r.n1) for r in leaves] == [(n_rows - 55, 0), (0, 55)]
    assert recommendation.Settings().max_leaves is None


def test_equal_rows_are_merged_and_grow_the_same_tree(spark, monkeypatch):
    # Few enough for Spark to take thresholds from all rows; each comes up to nine times.
    rows = spark.range(1_800).selectExpr(
        "double(pmod(xxhash64(id, 1), 10) < id % 7) AS label",
        "id % 7 AS few", "id % 11 AS some", "id % 457 / 7D AS many",
        "explode(sequence(1, 1 + id % 9)) AS i",
    ).drop("i")
    columns, n_rows = ["few", "some", "many"], rows.count()
    assert 4 * 1_800 < n_rows <= 10_000
    shape = lambda m: m.stages[-1].stages[-1].toDebugString.split("\n", 1)[1]
    budgets = (1, 5, models.MAX_LEAVES, None)
    plain = [models.fit(rows, columns, models.decision_tree(), b) for b in budgets]
    assert plain[-1].stages[-1].stages[-1].numNodes > 50
    tables = []
    monkeypatch.setattr(models, "stored", lambda df, n: tables.append(stored(df, n)) or tables[-1])
    monkeypatch.setattr(models, "WEIGHT_PARTS", n_rows // 3)
    monkeypatch.setattr(models, "MERGE_FACTOR", 1)
    merged = [models.fit(rows, columns, models.decision_tree(), b) for b in budgets]
    # A single leaf holds all rows, so its budget leaves nothing to merge for.
    assert len(tables) == len(budgets) - 1
    told = tables[0].agg(F.sum("weight"), F.max("weight"), F.count("*")).first()
    assert told[:2] == (n_rows, 3) and told[2] < n_rows
    assert [shape(m) for m in merged] == [shape(m) for m in plain]
    nodes = [sorted(models.tree_nodes(m[-1]).collect(), key=str) for m in (plain, merged)]
    assert nodes[0] == nodes[1]


def test_rows_that_differ_and_other_classifiers_are_not_merged(wide, monkeypatch):
    base = stored(wide.where(F.col("split") == labels.BASE), "base")
    monkeypatch.setattr(models, "WEIGHT_PARTS", 10)
    monkeypatch.setattr(models, "stored", lambda *_: pytest.fail("merged"))
    by_pair = base.select("label", F.xxhash64("user1", "user2").cast("double").alias("x"))
    models.fit(by_pair, ["x"], models.decision_tree())
    models.fit(base, features.RELATION_FEATURES, models.logistic_regression())


def test_stacked_fit_reads_scores_that_are_stored_once(wide, monkeypatch):
    read = []
    fit = models.fit
    monkeypatch.setattr(models, "fit", lambda rows, *a: read.append(rows) or fit(rows, *a))
    models.fit_stacked(labels.train_pairs(wide))
    plan = read[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "base_scores" in read[-1].inputFiles()[0]


@pytest.mark.parametrize("name", ["type", "user"])
def test_nodes_and_gains_are_those_of_the_rows(wide, name):
    base = stored(wide.where(F.col("split") == labels.BASE), "base")
    model = models.fit(base, features.FEATURE_SETS[name], models.decision_tree())
    nodes = models.tree_nodes(model)
    passed = stored(models.paths(model, base, nodes, ["user1", "user2"]), "paths")
    told = models.recounted(nodes, passed).collect()
    assert len(told) == model.stages[-1].stages[-1].numNodes > 1
    for r in told:
        assert (r.n0, r.n1) == (r.m0, r.m1)
        if r.left_id is None:
            assert r.own_gain is None and r.n0 + r.n1 >= 50
        else:
            assert r.own_gain == pytest.approx(r.gain, abs=1e-9)
    # A row's leaf gives its score.
    leaves = nodes.where("feature is null").select("id", (F.col("n1") / (F.col("n0") + F.col("n1"))).alias("q"))
    scored = models.add_score(model, base, "p").join(passed.drop("label"), ["user1", "user2"])
    scored = scored.join(leaves, "id")
    assert scored.count() == base.count()
    assert scored.where("abs(p - q) > 1e-12").count() == 0


def test_rows_go_down_several_levels_per_stored_table(spark, wide, monkeypatch):
    base = stored(wide.where(F.col("split") == labels.BASE), "base")
    model = models.fit(base, features.PROFILE_FEATURES, models.decision_tree())
    nodes = models.tree_nodes(model)
    tables = []
    monkeypatch.setattr(models, "stored", lambda df, name: tables.append(name) or stored(df, name))
    passed = models.paths(model, base, nodes, ["user1", "user2"])
    depth = model.stages[-1].stages[-1].depth
    assert depth > 1 and len(tables) == max(1, depth // models.LEVELS + 1)
    assert passed.where("id = 0").count() == base.count()
    assert passed.where("id is null").count() == 0


def test_suggestions_keep_the_rules(spark, edges, wide, stacked):
    report = recommendation.validate(stacked, wide).first()
    assert 0.0 < report["fbeta"] <= 1.0
    assert 0.0 <= report["auc"] <= 1.0
    k = 3
    found = stored(recommendation.suggest(stacked, wide, report["threshold"], k), "found")
    assert found.count() > 0
    assert found.where(f"user_id % {HOLDOUT_MODULUS} <> {HOLDOUT_REMAINDER}").count() == 0
    assert found.where(F.col("score") < report["threshold"]).count() == 0
    assert found.where(f"rank > {k}").count() == 0
    pairs = found.selectExpr(
        "least(user_id, friend_id) AS user1", "greatest(user_id, friend_id) AS user2"
    )
    known = labels.positive_pairs(edges)
    assert pairs.join(known, ["user1", "user2"], "left_semi").count() == 0
    lists = {r["user_id"]: r["friends"] for r in suggestion_lists(found).collect()}
    for user, friends in lists.items():
        rows = found.where(F.col("user_id") == user).orderBy("rank").collect()
        assert friends == [r["friend_id"] for r in rows]
        assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
        break


def test_top_k_is_cut_before_the_shuffle(spark):
    pairs = spark.range(1000).selectExpr("1L AS user1", "id + 2 AS user2", "id % 7 / 7D AS p")
    best = top_k(both_directions(pairs, "p"), 4)
    hub = best.where("user_id = 1").orderBy("rank").collect()
    assert [r["friend_id"] for r in hub] == [8, 15, 22, 29]
    plan = best._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("WindowGroupLimit [user_id", plan.index("WindowGroupLimit") + 1)
    assert plan.index("Exchange") < partial


def test_scores_stored_apart_are_merged(spark):
    key = "user1 long, user2 long, "
    labeled = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.0)], key + "label double")
    a = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.2)], key + "a double")
    b = spark.createDataFrame([(1, 3, 0.4), (1, 2, 0.3)], key + "b double")
    merged = {tuple(r) for r in models.merge_scores(labeled, a, b).collect()}
    assert merged == {(1, 2, 1.0, 0.1, 0.3), (1, 3, 0.0, 0.2, 0.4)}
    assert evaluate.auc_roc(models.merge_scores(labeled, a), "a").first()["auc"] == 0.0
