"""The whole run: friend lists and profiles in, ranked suggestions out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrec.functions.profiles import REFERENCE_MS, REFERENCE_MS_PARITY
from linkrec.operators.candidates import HUB_DEGREE, MIN_SCORE, pair_scores
from linkrec.operators.evaluate import BETA, auc_roc, best_threshold, fbeta_curve
from linkrec.operators.features import with_features
from linkrec.operators.graph import MIN_DEGREE, MIN_FRIENDS, flatten, group_members
from linkrec.operators.labels import (
    SPLIT_SEED,
    SPLIT_WEIGHTS,
    VALIDATION,
    label_pairs,
    test_pairs,
    train_pairs,
    with_split,
    without_friends,
)
from linkrec.operators.models import MAX_LEAVES, STACKED, StackedModel, fit_stacked
from linkrec.operators.recommend import (
    TOP_K,
    both_directions,
    for_holdout,
    suggestion_lists,
    top_k,
)
from linkrec.sources import text
from linkrec.storage import input_files, input_identity, kept, stored, temporary_tables


@dataclass
class Settings:
    # Owners who list fewer people, and people listed by fewer owners, make no pairs.
    min_friends: int = MIN_FRIENDS
    min_degree: int = MIN_DEGREE
    min_score: float = MIN_SCORE
    weight: str = "flat"
    hub_degree: int = HUB_DEGREE
    inversion: str = "canonical"
    count_close_family: bool = True
    reference_ms: int = REFERENCE_MS
    k: int = TOP_K
    # Leaves of a tree at most, as it lives on the driver; None sets no bound.
    max_leaves: int | None = MAX_LEAVES
    # Shares of the base models, the stacked model and validation, and the seed of the split.
    split_weights: list[float] = field(default_factory=lambda: list(SPLIT_WEIGHTS))
    split_seed: int = SPLIT_SEED
    # Recall counts beta times as much as precision where the threshold is chosen.
    beta: float = BETA
    # Bins of the F curve in validation; 0 keeps every distinct score.
    num_bins: int = 0
    # Where members and pairs are kept for later runs; None keeps neither.
    folder: str | None = None


# Settings that repeat the known quirks: close family is not counted, and
# account ages are counted to the far date.
PARITY = Settings(count_close_family=False, reference_ms=REFERENCE_MS_PARITY, num_bins=100)


def _fingerprint(edges: DataFrame) -> str:
    """Stands for the rows of ``edges``, in any order."""
    row = F.xxhash64(*edges.columns) % F.lit(1_000_000_007)
    content = edges.agg(F.count("*"), F.sum(row), F.sum(row * row % 998_244_353)).first()
    return sha256(repr(tuple(content)).encode()).hexdigest()[:16]


def _told(*settings: object) -> str:
    return sha256(repr(settings).encode()).hexdigest()[:16]


def _of_members(s: Settings, made_from: str) -> str:
    return f"-{made_from}-" + _told(s.inversion, s.min_friends, s.min_degree)


def _of_pairs(s: Settings, made_from: str) -> str:
    of_members = _of_members(s, made_from)
    return f"{of_members}-" + _told(s.min_score, s.weight, s.count_close_family)


def candidate_pairs(
    edges: DataFrame, settings: Settings | None = None, made_from: str | None = None
) -> DataFrame:
    """pairs(user1, user2, score, packed) of ``edges``, as a stored table.

    ``edges`` should be a stored table too.  Kept tables are named by what they were
    made from, so other rows or other settings never get them.  ``made_from`` stands for
    the rows of ``edges``, say ``input_identity`` of their files; without it they are all
    read once to find such a name.
    """
    s = settings or Settings()
    spark = edges.sparkSession
    of_members = of_pairs = ""
    if s.folder is not None:
        made_from = made_from or _fingerprint(edges)
        of_members, of_pairs = _of_members(s, made_from), _of_pairs(s, made_from)

    def build_members() -> DataFrame:
        return group_members(
            edges, s.min_friends, s.min_degree, inversion=s.inversion, n_edges=edges.count()
        )

    def build_pairs() -> DataFrame:
        scored = pair_scores(
            kept(spark, f"members{of_members}", build_members, s.folder),
            min_score=s.min_score,
            weight=s.weight,
            hub_degree=s.hub_degree,
            count_close_family=s.count_close_family,
        )
        return scored.select("user1", "user2", "score", "packed")

    return kept(spark, f"pairs{of_pairs}", build_pairs, s.folder)


def wide_pairs(
    edges: DataFrame,
    profiles: DataFrame,
    settings: Settings | None = None,
    made_from: str | None = None,
) -> DataFrame:
    """Labelled pairs with all features and their split, as a stored table.

    It is kept as well where ``made_from`` stands for the rows of both inputs.
    """
    s = settings or Settings()

    def build() -> DataFrame:
        pairs = candidate_pairs(edges, s, made_from)
        labeled = stored(label_pairs(pairs, edges), "labeled_pairs")
        wide = with_features(labeled, profiles, s.reference_ms)
        return with_split(wide, s.split_weights, s.split_seed)

    if s.folder is None or made_from is None:
        return stored(build(), "wide_pairs")
    of_wide = _told(s.reference_ms, s.split_weights, s.split_seed)
    name = f"wide{_of_pairs(s, made_from)}-{of_wide}"
    return kept(edges.sparkSession, name, build, s.folder)


def validate(
    model: StackedModel, wide: DataFrame, num_bins: int = 0, beta: float = BETA
) -> DataFrame:
    """One row (threshold, fbeta, auc) from the validation split."""
    held = train_pairs(wide).where(F.col("split") == VALIDATION)
    scored = stored(model.transform(held).select("label", STACKED), "validation")
    best = best_threshold(fbeta_curve(scored, STACKED, beta, num_bins))
    return best.withColumn("auc", auc_roc(scored, STACKED).scalar())


def suggest(
    model: StackedModel, wide: DataFrame, threshold: float, k: int = TOP_K
) -> DataFrame:
    """(user_id, friend_id, score, rank) for held-out users."""
    strangers = without_friends(test_pairs(wide))
    directed = both_directions(model.transform(strangers), STACKED)
    rounded = directed.withColumn("score", F.round("score", 6))
    return top_k(for_holdout(rounded, threshold), k)


def recommend(
    edges: DataFrame,
    profiles: DataFrame,
    settings: Settings | None = None,
    strategy: dict[str, Callable[[], Estimator]] | None = None,
    made_from: str | None = None,
) -> DataFrame:
    """Train on the pairs of known users and suggest friends for held-out ones.

    ``strategy`` names the classifier of a stage where it is to be another one.
    ``made_from`` stands for the rows of ``edges``, then a stored table, and ``profiles``.
    """
    s = settings or Settings()
    wide = wide_pairs(edges if made_from else stored(edges, "edges"), profiles, s, made_from)
    model = fit_stacked(train_pairs(wide), strategy, s.max_leaves)
    report = validate(model, wide, s.num_bins, s.beta).first()
    if report is None:
        raise ValueError("no validation pairs to choose a threshold from")
    return suggest(model, wide, report["threshold"], s.k)


def recommend_text(
    spark: SparkSession,
    adjacency: str,
    profiles: str,
    target: str,
    settings: Settings | None = None,
    strategy: dict[str, Callable[[], Estimator]] | None = None,
    on_bad: str = "fail",
    rejected: str | None = None,
) -> None:
    """From folders of friend lists and of profiles to a new folder of gzip lines.

    Each line has a held-out user and the friends suggested, best first, joined by tabs;
    users without suggestions have none.  The last line of a profile counts.  ``on_bad``
    says what becomes of lines that do not parse: they stop the run, or ("skip") are left
    out and written to the folders ``lists`` and ``profiles`` of ``rejected``, if given,
    which replace those of an earlier run.

    What is stored on the way is removed at the end, after a failure as well, but for
    tables in ``settings.folder``.  Those are named by the files that they were made from
    (``inputs`` lists them) and the settings; a later run goes on from the complete ones
    without reading the files, as long as path, length and time of none has changed.
    """
    s = settings or Settings()
    if rejected is not None and on_bad != "skip":
        raise ValueError('lines are only rejected with on_bad="skip"')
    with temporary_tables(spark):
        made_from = None
        if s.folder is not None:
            files = input_identity(spark, adjacency, profiles)
            made_from = f"{files}-{on_bad}"
            listed = lambda: input_files(spark, adjacency, profiles)
            kept(spark, f"inputs-{made_from}", listed, s.folder)
        lists, last, left_out = _parsed(spark, adjacency, profiles, on_bad, s.folder, made_from)
        edges, latest = flatten(lists), last
        if made_from is not None:
            edges = kept(spark, f"edges-{made_from}", lambda: flatten(lists), s.folder)
            latest = kept(spark, f"profiles-{made_from}", lambda: last, s.folder)
            if input_identity(spark, adjacency, profiles) != files:
                raise RuntimeError("files changed while they were read")
        for name, lines in left_out.items() if rejected is not None else ():
            lines.write.mode("overwrite").text(f"{rejected}/{name}")
        ranked = recommend(edges, latest, s, strategy, made_from)
        text.write_recommendations(suggestion_lists(ranked), target)


def _parsed(
    spark: SparkSession,
    adjacency: str,
    profiles: str,
    on_bad: str,
    folder: str | None,
    made_from: str | None,
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Friend lists, the last profile of each user, and lines left out, by kind."""
    lines, people = spark.read.text(adjacency), text.profile_lines(spark, profiles)
    left_out = {}
    if on_bad == "skip":
        at = {n: folder and f"{folder}/{n}-{made_from}" for n in ("lists", "people")}
        lists, left_out["lists"] = text.sorted_adjacency(lines, at["lists"])
        known, left_out["profiles"] = text.sorted_profiles(people, at["people"])
    else:
        lists = text.parse_adjacency(lines, on_bad)
        known = text.parse_profiles(people, on_bad)
    return lists, text.latest_profiles(known, "line_order"), left_out
