import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from linkrec.operators import evaluate as ev


def scored(spark, n=500, top=3.0, digits=2, seed=1):
    rng = random.Random(seed)
    rows = [(round(rng.random() * top, digits), float(rng.random() < 0.3)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "p double, label double")


def brute_curve(rows, beta):
    positives = sum(label for _, label in rows)
    out = {}
    for t in {p for p, _ in rows}:
        tp = sum(label for p, label in rows if p >= t)
        above = sum(1 for p, _ in rows if p >= t)
        precision, recall = tp / above, tp / positives
        b2 = beta * beta
        f = (1 + b2) * precision * recall / (b2 * precision + recall) if tp else 0.0
        out[t] = (tp, above - tp, precision, recall, f)
    return out


@pytest.mark.parametrize("beta", [2.0, 0.5])
def test_curve_equals_brute_force(spark, monkeypatch, beta):
    monkeypatch.setattr(ev, "BIN_SIZE", 5)  # some 50 bins
    rows, df = scored(spark)
    want = brute_curve(rows, beta)
    got = {r["threshold"]: tuple(r)[1:] for r in ev.fbeta_curve(df, "p", beta).collect()}
    assert got.keys() == want.keys()
    for t in want:
        assert got[t] == pytest.approx(want[t])
    best = ev.best_threshold(ev.fbeta_curve(df, "p", beta)).first()
    assert best["fbeta"] == pytest.approx(max(w[4] for w in want.values()))


def test_auc_equals_sparks_own(spark):
    _, df = scored(spark, 2000, digits=4)
    own = BinaryClassificationEvaluator(rawPredictionCol="p", numBins=0).evaluate(df)
    assert ev.auc_roc(df, "p").first()["auc"] == pytest.approx(own)


def test_thinned_curve_keeps_about_as_many_points(spark):
    _, df = scored(spark, 3000, digits=5)
    full = {r["threshold"]: tuple(r) for r in ev.fbeta_curve(df, "p").collect()}
    thin = ev.fbeta_curve(df, "p", num_bins=100).collect()
    assert 100 <= len(thin) <= 110
    assert all(full[r["threshold"]] == tuple(r) for r in thin)
    assert min(r["threshold"] for r in thin) == min(full)


def test_one_class_only(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.7, 0.0)], "p double, label double")
    rows = ev.fbeta_curve(df, "p").collect()
    assert {r["fbeta"] for r in rows} == {0.0}
    assert ev.auc_roc(df, "p").first()["auc"] is None
    both = df.withColumn("label", F.lit(1.0))
    assert ev.best_threshold(ev.fbeta_curve(both, "p")).first()["threshold"] == 0.5


def test_ties_in_f_take_the_higher_threshold(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.5, 0.0), (0.4, 0.0)], "p double, label double")
    curve = df.selectExpr("p AS threshold", "1D AS fbeta")
    assert ev.best_threshold(curve).first()["threshold"] == 0.9


@pytest.mark.parametrize("top", [1e-9, 1e12])
def test_scores_that_differ_in_any_decimal(spark, monkeypatch, top):
    monkeypatch.setattr(ev, "BIN_SIZE", 20)
    rows, df = scored(spark, 400, top, digits=30)
    rows += [(-top, 1.0), (0.0, 0.0), (rows[0][0], 1.0)]
    df = spark.createDataFrame(rows, "p double, label double")
    curve = ev.fbeta_curve(df, "p", digits=None).collect()
    want = brute_curve(rows, 2.0)
    assert {r["threshold"]: tuple(r)[1:3] for r in curve} == {t: w[:2] for t, w in want.items()}
    ones = [p for p, label in rows if label]
    zeros = [p for p, label in rows if not label]
    wins = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
    got = ev.auc_roc(df, "p", digits=None).first()["auc"]
    assert got == pytest.approx(wins / len(ones) / len(zeros), abs=1e-12)


def test_bins_hold_about_as_many_scores_each(spark, monkeypatch):
    monkeypatch.setattr(ev, "BIN_SIZE", 100)
    rows = [(math.exp(random.Random(i).gauss(0, 9)), 1.0) for i in range(2000)]
    counts = ev.score_counts(spark.createDataFrame(rows, "p double, label double"), "p", None)
    sizes = [r["count"] for r in ev.in_ranges(counts).groupBy("bin").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 160
    monkeypatch.setattr(ev, "MAX_BINS", 4)
    assert ev.in_ranges(counts).select("bin").distinct().count() == 4


def test_scores_that_are_missing_or_no_number(spark, monkeypatch):
    monkeypatch.setattr(ev, "BIN_SIZE", 2)
    nan = float("nan")
    rows = [(None, 1.0), (nan, 0.0), (nan, 1.0), (0.5, 1.0), (0.25, 0.0), (0.125, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "p double, label double")
    got = ev.fbeta_curve(df, "p", digits=None).orderBy(F.desc("threshold")).collect()
    assert [(r["tp"], r["fp"]) for r in got] == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3)]
    assert ev.fbeta_curve(df.limit(0), "p").count() == 0
