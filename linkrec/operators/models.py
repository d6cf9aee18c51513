"""Classifiers and stacking on pyspark.ml.

All scores stay columns of the pairs' own rows: nothing is joined back by key.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrec.operators.features import FEATURE_SETS
from linkrec.operators.labels import BASE, ENSEMBLE
from linkrec.storage import fresh_path, stored

# The classifiers' parameters.
LOGISTIC = {"fitIntercept": False, "regParam": 0.0, "maxIter": 100, "tol": 1e-6}
TREE = {"impurity": "gini", "maxBins": 64, "maxDepth": 30, "minInstancesPerNode": 50}
MAX_CATEGORIES = 5
# How trees are grown, without effect on the result: rows remember their node,
# and more nodes are split per pass over the data.
TREE_GROWTH = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 1024}

# Levels of a tree that rows go down before they are stored.
LEVELS = 5

# Leaves of a tree at most; None leaves that to the classifier's own parameters.
MAX_LEAVES: int | None = None

# Trees are grown on rows that stand for several equal ones, each for at most one in so many
# of all: Spark looks for thresholds in a sample of rows, which none of them is to sway.
WEIGHT_PARTS = 200_000
# Only where so many times fewer rows are left.
MERGE_FACTOR = 2

STACKED_SCORES = ["p_aa", "p_type", "p_user"]
STACKED = "p_stacked"


def with_label_values(df: DataFrame) -> DataFrame:
    """Declare the label as one of 0 and 1, so that a tree trained on rows of
    one class still gives two probabilities."""
    meta = {"ml_attr": {"type": "nominal", "name": "label", "vals": ["0.0", "1.0"]}}
    return df.withColumn("label", F.col("label").cast("double").alias("label", metadata=meta))


def logistic_regression(**changed) -> Estimator:
    """Without intercept; ``changed`` parameters of Spark's estimator, say a smaller ``tol``."""
    return LogisticRegression(**{**LOGISTIC, **changed})


def decision_tree(min_leaf_share: float = 0.0) -> Estimator:
    """Index features of few values as categories, then grow a tree.

    The tree lives on the driver.  It has as many leaves as the rows give, at least 50 rows
    each; ``min_leaf_share`` (say 1e-5), the least share of all rows in a leaf, bounds them if
    asked to, and so does ``max_leaves`` of ``fit``.
    """
    indexer = VectorIndexer(
        inputCol="features",
        outputCol="indexed_features",
        maxCategories=MAX_CATEGORIES,
        handleInvalid="keep",
    )
    tree = DecisionTreeClassifier(
        featuresCol="indexed_features",
        minWeightFractionPerNode=min_leaf_share,
        **TREE,
        **TREE_GROWTH,
    )
    return Pipeline(stages=[indexer, tree])


# Which classifier each stage uses.
STRATEGY: dict[str, Callable[[], Estimator]] = {
    "aa": logistic_regression,
    "type": decision_tree,
    "user": decision_tree,
    "stacked": decision_tree,
}


def with_leaf_budget(estimator: Estimator, n_rows: int, max_leaves: int) -> Estimator:
    """``estimator`` with no more than ``max_leaves`` leaves in any tree, on all rows.

    A leaf gets at least an equal share of the rows, so there cannot be more.  As long as
    that share is below the tree's own least number of rows per node, nothing changes.
    """
    share = -(-n_rows // max_leaves)
    if isinstance(estimator, Pipeline):
        stages = [with_leaf_budget(e, n_rows, max_leaves) for e in estimator.getStages()]
        return Pipeline(stages=stages)
    if estimator.hasParam("minInstancesPerNode"):
        least = max(share, estimator.getOrDefault("minInstancesPerNode"))
        return estimator.copy({estimator.getParam("minInstancesPerNode"): least})
    return estimator


def _tree_of(estimator: Estimator) -> DecisionTreeClassifier | None:
    """The tree that ``estimator`` grows, if that is all it learns but for indexed features."""
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    plain = all(isinstance(e, VectorIndexer) for e in stages[:-1])
    tree = stages[-1] if stages and plain else None
    if not isinstance(tree, DecisionTreeClassifier) or tree.isDefined(tree.weightCol):
        return None
    return tree


def with_merged_rows(
    estimator: Estimator, rows: DataFrame, n_rows: int | None
) -> tuple[Estimator, DataFrame]:
    """``estimator`` and ``rows``, with equal rows merged and weighed where that grows the
    same tree from far fewer.

    A node's classes are weighed rather than counted, so its least number of rows becomes a
    least share of the weight.  Weights are whole numbers, which sum up exactly.
    """
    tree, most = _tree_of(estimator), (n_rows or 0) // WEIGHT_PARTS
    if tree is None or most < 2 or 2 * tree.getMinInstancesPerNode() > n_rows:
        return estimator, rows
    different = rows.agg(F.approx_count_distinct(F.xxhash64(*rows.columns))).first()[0]
    if (different + n_rows / most) * MERGE_FACTOR > n_rows:
        return estimator, rows
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    parts = f"transform(sequence(0L, (n - 1) div {most}), i -> double(least({most}, n - i * {most})))"
    merged = counted.select(*rows.columns, F.explode(F.expr(parts)).alias("weight"))
    # Half a row less, as the product with the weight of all may be rounded.
    share = (tree.getMinInstancesPerNode() - 0.5) / n_rows
    weighed = tree.copy(
        {
            tree.weightCol: "weight",
            tree.minInstancesPerNode: 1,
            tree.minWeightFractionPerNode: max(share, tree.getMinWeightFractionPerNode()),
        }
    )
    if isinstance(estimator, Pipeline):
        weighed = Pipeline(stages=[*estimator.getStages()[:-1], weighed])
    return weighed, stored(merged, "merged_rows")


def fit(
    training: DataFrame,
    columns: list[str],
    estimator: Estimator,
    max_leaves: int | None = MAX_LEAVES,
) -> PipelineModel:
    """Assemble ``columns`` into a vector and fit on ``label``, on all rows.

    ``max_leaves``, if given, bounds what a tree takes on the driver.
    """
    rows, n_rows = training.select("label", *columns), None
    if max_leaves is not None or _tree_of(estimator) is not None:
        n_rows = training.count()
    if max_leaves is not None:
        estimator = with_leaf_budget(estimator, n_rows, max_leaves)
    estimator, rows = with_merged_rows(estimator, rows, n_rows)
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    return Pipeline(stages=[assembler, estimator]).fit(with_label_values(rows))


def add_score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Add the probability of class 1 as column ``name``."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


@dataclass
class StackedModel:
    """Base models by feature set and the model over their scores."""

    base: dict[str, PipelineModel]
    stacked: PipelineModel

    def add_base_scores(self, df: DataFrame) -> DataFrame:
        for name, model in self.base.items():
            df = add_score(model, df, f"p_{name}")
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return add_score(self.stacked, self.add_base_scores(df), STACKED)


def fit_base(
    wide: DataFrame,
    strategy: dict[str, Callable[[], Estimator]] | None = None,
    max_leaves: int | None = MAX_LEAVES,
) -> dict[str, PipelineModel]:
    """One model per feature set, on the base split.

    The fits do not depend on each other, so their jobs run side by side.
    """
    chosen = {**STRATEGY, **(strategy or {})}
    training = wide.where(F.col("split") == BASE)
    with ThreadPoolExecutor(len(FEATURE_SETS)) as pool:
        fits = {
            name: pool.submit(
                inheritable_thread_target(training.sparkSession)(fit),
                training, columns, chosen[name](), max_leaves,
            )
            for name, columns in FEATURE_SETS.items()
        }
        return {name: done.result() for name, done in fits.items()}


def fit_stacked(
    wide: DataFrame,
    strategy: dict[str, Callable[[], Estimator]] | None = None,
    max_leaves: int | None = MAX_LEAVES,
) -> StackedModel:
    """Base models on the base split, the model over their scores on the
    ensemble split.  ``wide`` should be a stored table, as it is read often."""
    chosen = {**STRATEGY, **(strategy or {})}
    model = StackedModel(fit_base(wide, strategy, max_leaves), None)
    scored = model.add_base_scores(wide.where(F.col("split") == ENSEMBLE))
    # A fit reads its rows several times, and each would be scored anew.
    scored = stored(scored.select("label", *STACKED_SCORES), "base_scores")
    model.stacked = fit(scored, STACKED_SCORES, chosen["stacked"](), max_leaves)
    return model


# -- what a tree is made of ---------------------------------------------------


def tree_nodes(model: PipelineModel) -> DataFrame:
    """The nodes of a fitted tree, as a stored table.

    (id, feature, threshold, categories, left_id, right_id, n0, n1, gain): a row goes left
    if its feature is at most the threshold or, for a categorical feature, one of the
    categories that go left.  Leaves have no feature.  n0 and n1 count the training rows of
    either class that reach the node; ``gain`` is what the split takes off Gini impurity.
    """
    tree = model.stages[-1].stages[-1]
    spark = SparkSession.active()
    path = fresh_path(spark, "tree")
    tree.write().save(path)
    cut = "split.leftCategoriesOrThreshold"
    number = "split.numCategories"
    return spark.read.parquet(f"{path}/data").selectExpr(
        "id",
        "if(leftChild >= 0, split.featureIndex, null) AS feature",
        f"if(leftChild >= 0 and {number} < 0, {cut}[0], null) AS threshold",
        f"if(leftChild >= 0 and {number} >= 0, {cut}, null) AS categories",
        "if(leftChild >= 0, leftChild, null) AS left_id",
        "if(leftChild >= 0, rightChild, null) AS right_id",
        "bigint(impurityStats[0]) AS n0",
        "bigint(impurityStats[1]) AS n1",
        "if(leftChild >= 0, gain, null) AS gain",
    )


def paths(model: PipelineModel, rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., label, id): every node that each of ``rows`` passes, root to leaf.

    Rows go down LEVELS levels at a time, joined with the nodes, which are few next to them.
    """
    indexed = rows
    for stage in [model.stages[0], *model.stages[-1].stages[:-1]]:
        indexed = stage.transform(indexed)
    level = indexed.select(
        *keys, "label", vector_to_array("indexed_features").alias("x"), F.lit(0).alias("id")
    )
    passed = level.select(*keys, "label", "id")
    inner = nodes.where("feature is not null").select(
        "id", "feature", "threshold", "categories", "left_id", "right_id"
    )
    value = F.expr("get(x, feature)")
    left = F.when(F.col("categories").isNull(), value <= F.col("threshold")).otherwise(
        F.array_contains("categories", value)
    )
    # A row at a leaf finds no inner node, and from there on has none.
    below = F.when(left, F.col("left_id")).otherwise(F.col("right_id"))
    while True:
        for at in range(LEVELS):
            steps = [f"id{i}" for i in range(at)]
            level = level.join(inner, "id", "left").select(
                *keys, "label", "x", *steps, F.col("id").alias(f"id{at}"), below.alias("id")
            )
        seen = F.array_compact(F.array(*[f"id{i}" for i in range(1, LEVELS)], "id"))
        walked = stored(level.select(*keys, "label", "x", "id", seen.alias("seen")), "level")
        passed = passed.union(walked.select(*keys, "label", F.explode("seen")))
        level = walked.where("id is not null").drop("seen")
        if level.isEmpty():
            return passed


def recounted(nodes: DataFrame, passed: DataFrame) -> DataFrame:
    """``nodes`` with (m0, m1, own_gain) counted anew from the ``paths`` of the training rows."""
    counts = passed.groupBy("id").agg(
        F.sum(F.expr("int(label = 0)")).alias("m0"), F.sum(F.expr("int(label = 1)")).alias("m1")
    )
    gini = lambda a, b: f"(1 - pow({a} / ({a} + {b}), 2) - pow({b} / ({a} + {b}), 2))"
    side = lambda s: counts.selectExpr(f"id AS {s}_id", f"m0 AS {s}0", f"m1 AS {s}1")
    gain = f"""{gini('m0', 'm1')} - ((left0 + left1) * {gini('left0', 'left1')}
        + (right0 + right1) * {gini('right0', 'right1')}) / (m0 + m1) AS own_gain"""
    joined = nodes.join(counts, "id", "left")
    joined = joined.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    return joined.selectExpr(*nodes.columns, "m0", "m1", gain)


def merge_scores(labeled: DataFrame, *scores: DataFrame) -> DataFrame:
    """Join scores that were stored apart to the labels by pair."""
    for score in scores:
        labeled = labeled.join(score, ["user1", "user2"])
    return labeled
