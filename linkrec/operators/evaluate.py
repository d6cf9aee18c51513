"""Quality of a score: F-beta by threshold, best threshold, area under ROC."""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrec.storage import stored

# Beta of the F measure, and decimals by which scores differ.
BETA = 2.0
DIGITS = 6
# Distinct scores whose running sums are to be formed in one task, and bins at most.  The
# bounds of the bins are a list on the driver; with more scores bins get longer instead,
# and running sums read a long bin as a stream that spills.
BIN_SIZE = 65_536
MAX_BINS = 4_096


def score_counts(scored: DataFrame, score: str, digits: int | None = DIGITS) -> DataFrame:
    """(threshold, pos, neg): labels per distinct score, as a stored table.

    ``digits=None`` tells all scores apart.  Rows without a score are left out.
    """
    label = F.col("label").cast("bigint")
    value = F.col(score) if digits is None else F.round(score, digits)
    counts = (
        scored.where(F.col(score).isNotNull())
        .groupBy(value.alias("threshold"))
        .agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg"))
    )
    return stored(counts, "score_counts")


def in_ranges(counts: DataFrame) -> DataFrame:
    """Add ``bin``: ranges of ``threshold`` in order, of about equally many rows each.

    The bounds are quantiles, from summaries that tasks form and merge, so they follow the
    scores wherever those lie.  NaN counts as the largest score.
    """
    n_bins = min(MAX_BINS, -(-counts.count() // BIN_SIZE))
    if n_bins < 2:
        return counts.withColumn("bin", F.lit(0.0))
    ranges = QuantileDiscretizer(
        numBuckets=n_bins,
        relativeError=1 / (4 * n_bins),
        inputCol="threshold",
        outputCol="bin",
        handleInvalid="keep",
    )
    real = counts.where(~F.isnan("threshold"))
    return ranges.fit(real).transform(counts)


def running_totals(counts: DataFrame) -> DataFrame:
    """Add ``tp``, ``fp`` and ``n_above``: totals over all scores >= threshold.

    Scores are put in bins by value, of about BIN_SIZE different scores each; only the
    bins' totals are summed up in one task.  ``counts`` should be a stored table.
    """
    binned = in_ranges(counts)
    totals = binned.groupBy("bin").agg(
        F.sum("pos").alias("bin_pos"), F.sum("neg").alias("bin_neg"), F.count("*").alias("bin_n")
    )
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "bin",
        *[
            F.coalesce(F.sum(f"bin_{c}").over(above), F.lit(0)).alias(f"before_{c}")
            for c in ("pos", "neg", "n")
        ],
    )
    within = Window.partitionBy("bin").orderBy(F.desc("threshold"))
    return (
        binned.withColumns(
            {
                "tp": F.sum("pos").over(within),
                "fp": F.sum("neg").over(within),
                "n_above": F.row_number().over(within).cast("bigint"),
            }
        )
        .join(before, "bin")
        .select(
            "threshold",
            "pos",
            "neg",
            (F.col("tp") + F.col("before_pos")).alias("tp"),
            (F.col("fp") + F.col("before_neg")).alias("fp"),
            (F.col("n_above") + F.col("before_n")).alias("n_above"),
        )
    )


def _thinned(curve: DataFrame, counts: DataFrame, num_bins: int) -> DataFrame:
    """Every so many points, so that about ``num_bins`` are left."""
    points = counts.agg(F.count("*")).scalar()
    step = F.floor(points / num_bins)
    kept = (step < 2) | (F.col("n_above") % step == 0) | (F.col("n_above") == points)
    return curve.where(kept)


def fbeta_curve(
    scored: DataFrame,
    score: str,
    beta: float = BETA,
    num_bins: int = 0,
    digits: int | None = DIGITS,
) -> DataFrame:
    """(threshold, tp, fp, precision, recall, fbeta) per distinct score, or for
    about ``num_bins`` of them, each standing for the scores above it too."""
    counts = score_counts(scored, score, digits)
    curve = running_totals(counts)
    if num_bins:
        curve = _thinned(curve, counts, num_bins)
    positives = counts.agg(F.sum("pos")).scalar()
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.when(positives == 0, 0.0).otherwise(F.try_divide(F.col("tp"), positives))
    # F straight from the counts: one division of whole numbers.
    b2 = beta * beta
    hits = (1 + b2) * F.col("tp")
    missed = b2 * (positives - F.col("tp"))
    return curve.select(
        "threshold",
        "tp",
        "fp",
        precision.alias("precision"),
        recall.alias("recall"),
        (hits / (hits + missed + F.col("fp"))).alias("fbeta"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The one row of highest F; the higher threshold on a tie."""
    rounded = F.round("fbeta", 12)
    return curve.orderBy(rounded.desc(), F.desc("threshold")).limit(1).select("threshold", "fbeta")


def auc_roc(scored: DataFrame, score: str, digits: int | None = DIGITS) -> DataFrame:
    """One row (auc): exact area under ROC by trapezoids, NULL for one class."""
    curve = running_totals(score_counts(scored, score, digits))
    area = F.sum(F.col("neg") * (2.0 * F.col("tp") - F.col("pos")))
    both = 2.0 * F.sum("pos") * F.sum("neg")
    return curve.agg(F.try_divide(area, both).alias("auc"))
