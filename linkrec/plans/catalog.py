"""Named queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrec.functions import profiles as pf
from linkrec.functions import relations as rel
from linkrec.operators import candidates as cand
from linkrec.operators import evaluate as ev
from linkrec.operators import features as feat
from linkrec.operators import graph, labels, models
from linkrec.operators import recommend as rec
from linkrec.plans import recommendation as run
from linkrec.sources import fixtures as fx
from linkrec.sources import stores, text
from linkrec.storage import fresh_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Groups of the test graph are either below 60 members or grow with the data.
HUB_DEGREE = 100
SHARP_TOL = 1e-15  # so that scores agree with Newton's method to all places shown
STAR_DEGREE, STAR_SCORE = 10, 2.5
TOP = 5
SLICE = 7
BETAS = [2.0, 0.5, 0.1]
SETTINGS = run.Settings(hub_degree=HUB_DEGREE)
PAIR_KEY = ["user1", "user2"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- shared inputs ---------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(fx.edges(spark, sf_dir), "edges")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return stored(graph.group_members(edges, n_edges=edges.count()), "members")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.candidate_pairs(_edges(spark, sf_dir), SETTINGS)


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return labels.label_pairs(run.candidate_pairs(edges, SETTINGS), edges)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.wide_pairs(_edges(spark, sf_dir), fx.all_profiles(spark, sf_dir), SETTINGS)


def _profiled_edges(
    spark: SparkSession, sf_dir: str, profiles: Query = fx.all_profiles
) -> DataFrame:
    """Profiles of both ends of every edge that leads to a larger id."""
    forward = fx.edges(spark, sf_dir).where("friend_id > user_id")
    pairs = forward.select(F.col("user_id").alias("user1"), F.col("friend_id").alias("user2"))
    return feat.with_profiles(stored(pairs, "forward_edges"), profiles(spark, sf_dir))


# -- text sources ----------------------------------------------------------


@query
def adjacency_parse(spark, sf_dir):
    return graph.flatten(text.parse_adjacency(fx.adjacency_text(spark, sf_dir)))


def _mixed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per customer, four kinds of which are no lists."""
    return fx.table(spark, sf_dir, "customer").select(
        F.expr(
            """CASE c_custkey % 7
                 WHEN 0 THEN concat(c_custkey, '\t{}')
                 WHEN 1 THEN concat(c_custkey, '\t{(5,x)}')
                 WHEN 2 THEN concat('u', c_custkey, '\t{(5,16)}')
                 WHEN 3 THEN concat(c_custkey, '')
                 ELSE concat(c_custkey, '\t{(', c_custkey + 1, ',16),(7,3)}') END"""
        ).alias("value")
    )


@query
def adjacency_rejects(spark, sf_dir):
    return text.rejected_adjacency(_mixed_lists(spark, sf_dir))


@query
def adjacency_sorted(spark, sf_dir):
    """Whole and other lines of one pass: how many, and what is in them."""
    lists, rejected = text.sorted_adjacency(_mixed_lists(spark, sf_dir))
    sums = lists.select("user_id", F.explode("friends").alias("f")).agg(
        F.lit("whole").alias("kind"),
        F.count_distinct("user_id").alias("n_lines"),
        F.sum("f.friend_id").alias("total"),
    )
    lengths = rejected.agg(
        F.lit("rejected").alias("kind"),
        F.count("*").alias("n_lines"),
        F.sum(F.length("value").cast("bigint")).alias("total"),
    )
    return sums.union(lengths)


@query
def profile_parse(spark, sf_dir):
    return text.parse_profiles(fx.profile_text(spark, sf_dir))


@query
def profile_rejects(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "customer").select(
        F.expr(
            """CASE c_custkey % 5
                 WHEN 0 THEN concat('\t', c_custkey, '\t9')
                 WHEN 1 THEN concat(c_custkey, '\tsoon\t9')
                 ELSE concat(c_custkey, '\t\t9') END"""
        ).alias("value")
    )
    return text.rejected_profiles(lines)


@query
def profile_latest(spark, sf_dir):
    return text.latest_profiles(
        fx.profile_versions(spark, sf_dir), ["o_orderdate", "o_orderkey"]
    )


# -- relation masks --------------------------------------------------------


@query
def mask_normalize(spark, sf_dir):
    return fx.edges(spark, sf_dir)


@query
def mask_invert(spark, sf_dir):
    return fx.raw_edges(spark, sf_dir).selectExpr(
        "user_id",
        "friend_id",
        f"{rel.invert('raw_mask')} AS canonical",
        f"{rel.invert('raw_mask', 'swap')} AS swapped",
    )


@query
def mask_buckets(spark, sf_dir):
    full, main = rel.full_buckets("mask"), rel.main_buckets("mask")
    return fx.edges(spark, sf_dir).selectExpr(
        "user_id",
        "friend_id",
        f"{full} AS full_buckets",
        f"{main} AS main_buckets",
        f"{rel.first_bucket(full)} AS first_full",
        f"{rel.first_bucket(main)} AS first_main",
    )


def _mask_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge's mask next to that of the edge's mirror id, or to itself."""
    other = F.expr(
        """CASE WHEN (user_id + friend_id) % 3 = 0 THEN mask
                ELSE shiftleft(2, cast((user_id + 3 * friend_id) % 20 as int))
                     | shiftleft(2, cast((2 * user_id + friend_id) % 20 as int)) END"""
    )
    return fx.edges(spark, sf_dir).withColumn("mask2", other)


@query
def mask_combine(spark, sf_dir):
    return _mask_pairs(spark, sf_dir).selectExpr(
        "user_id",
        "friend_id",
        f"{rel.combine('mask', 'mask2')} AS bucket",
        f"{rel.combine('mask2', 'mask')} AS bucket_swapped",
    )


@query
def typed_weight(spark, sf_dir):
    combined = _mask_pairs(spark, sf_dir).selectExpr(
        "user_id",
        "friend_id",
        f"{rel.combine('mask', 'mask2')} AS bucket",
        f"{rel.full_buckets('mask')} AS full",
    )
    return combined.selectExpr(
        "user_id",
        "friend_id",
        f"round({rel.typed_weight('bucket')}, 6) AS weight",
        f"round({rel.typed_weight('full')}, 6) AS full_weight",
    )


# -- graph -----------------------------------------------------------------


@query
def reverse_edges(spark, sf_dir):
    return graph.reverse_edges(fx.edges(spark, sf_dir))


@query
def active_owner_edges(spark, sf_dir):
    return graph.active_owner_edges(fx.edges(spark, sf_dir))


@query
def busy_owner_edges(spark, sf_dir):
    return graph.active_owner_edges(fx.edges(spark, sf_dir), min_friends=14)


@query
def list_owners(spark, sf_dir):
    return graph.list_owners(fx.edges(spark, sf_dir))


@query
def group_members(spark, sf_dir):
    return graph.group_members(fx.edges(spark, sf_dir))


def _groups_read_back(spark: SparkSession, lists: DataFrame) -> DataFrame:
    path = fresh_path(spark, "groups")
    stores.write_groups(lists, path)
    shown = F.transform("members", lambda m: F.concat_ws(":", m["member_id"], m["mask"]))
    return stores.read_groups(spark, path).select(
        "mid_id", "chunk", "degree", F.concat_ws(" ", shown).alias("members")
    )


@query
def reverse_groups(spark, sf_dir):
    return _groups_read_back(spark, graph.group_lists(_members(spark, sf_dir)))


@query
def reverse_groups_chunked(spark, sf_dir):
    return _groups_read_back(spark, graph.group_lists(_members(spark, sf_dir), list_size=50))


@query
def groups_exploded(spark, sf_dir):
    lists = graph.group_lists(graph.group_members(fx.edges(spark, sf_dir)), list_size=50)
    return graph.explode_groups(lists)


# -- candidates ------------------------------------------------------------


@query
def wedges(spark, sf_dir):
    counts = cand.wedge_counts(_members(spark, sf_dir))
    return counts.groupBy("bucket").agg(F.sum("n_wedges").alias("n_wedges"))


@query
def wedge_scores(spark, sf_dir):
    counts = cand.wedge_counts(_members(spark, sf_dir))
    return counts.select(
        "degree",
        "bucket",
        "n_wedges",
        F.round(cand.wedge_weight("flat"), 6).alias("flat_weight"),
        F.round(cand.wedge_weight("typed"), 6).alias("typed_weight"),
    )


@query
def pair_wedges(spark, sf_dir):
    members = _members(spark, sf_dir)
    scored = cand.pair_scores(members, hub_degree=HUB_DEGREE)
    pairs = stored(scored.select(*PAIR_KEY), "pairs")
    found = cand.wedges_of_pairs(pairs, members, "typed")
    return found.withColumn("weight", F.round("weight", 6))


@query
def pair_scores(spark, sf_dir):
    members = _members(spark, sf_dir)
    return cand.pair_scores(members, hub_degree=HUB_DEGREE).select(*PAIR_KEY, "score")


def _hub_pairs(spark: SparkSession, sf_dir: str, who: str) -> DataFrame:
    edges = stored(fx.edges(spark, sf_dir, who), "star_edges")
    members = stored(graph.group_members(edges, n_edges=edges.count()), "star_members")
    scored = cand.pair_scores(members, min_score=STAR_SCORE, hub_degree=STAR_DEGREE)
    return scored.select(*PAIR_KEY, "score", "packed")


@query
def hub_pair_scores(spark, sf_dir):
    """Pairs that reach a higher cut in hubs alone: every group is one, of about one size."""
    return _hub_pairs(spark, sf_dir, fx.STAR)


@query
def fame_pair_scores(spark, sf_dir):
    """The same where some hubs are far larger than others."""
    return _hub_pairs(spark, sf_dir, fx.FAME)


@query
def typed_pair_scores(spark, sf_dir):
    members = _members(spark, sf_dir)
    scored = cand.pair_scores(members, weight="typed", hub_degree=HUB_DEGREE)
    return scored.select(*PAIR_KEY, "score")


@query
def pair_bucket_counts(spark, sf_dir):
    members = _members(spark, sf_dir)
    return cand.pair_scores(members, hub_degree=HUB_DEGREE).select(*PAIR_KEY, *rel.COUNT_COLUMNS)


@query
def packed_counters(spark, sf_dir):
    return _pairs(spark, sf_dir).selectExpr(
        *PAIR_KEY,
        "packed",
        f"{rel.read_counter('packed', 'SCHOOL')} AS school",
        f"{rel.read_counter('packed', 'PLAY')} AS play",
        f"{rel.merge_counters('packed', 'packed')} AS doubled",
        f"{rel.bucket_counter(rel.first_bucket('int(pmod(user1, 256))'))} AS one",
    )


@query
def uncounted_close_family(spark, sf_dir):
    members = _members(spark, sf_dir)
    scored = cand.pair_scores(members, hub_degree=HUB_DEGREE, count_close_family=False)
    return scored.select(*PAIR_KEY, "n_close_family", "packed")


@query
def pair_slice(spark, sf_dir):
    return cand.pair_slice(_pairs(spark, sf_dir), SLICE).select(*PAIR_KEY, "score")


@query
def pair_store_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "pair_store")
    stores.write_pairs(_pairs(spark, sf_dir), path)
    return stores.read_pairs(spark, path).select(*PAIR_KEY, "score", "packed", "slice")


# -- labels and splits -----------------------------------------------------


@query
def positive_pairs(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return labels.positive_pairs(edges, edges.count())


@query
def labeled_pairs(spark, sf_dir):
    return _labeled(spark, sf_dir).select(*PAIR_KEY, "score", "label")


@query
def non_friend_pairs(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    pairs = run.candidate_pairs(edges, SETTINGS)
    return labels.non_friends(pairs, edges).select(*PAIR_KEY, "score")


@query
def holdout_train(spark, sf_dir):
    return labels.train_pairs(_pairs(spark, sf_dir)).select(*PAIR_KEY, "score")


@query
def holdout_test(spark, sf_dir):
    return labels.test_pairs(_pairs(spark, sf_dir)).select(*PAIR_KEY, "score")


@query
def hash_split(spark, sf_dir):
    split = labels.with_split(labels.train_pairs(_pairs(spark, sf_dir)))
    return split.select(*PAIR_KEY, "split")


# -- features --------------------------------------------------------------


@query
def age_features(spark, sf_dir):
    years1, years2 = pf.whole_years("age_days1"), pf.whole_years("age_days2")
    return _profiled_edges(spark, sf_dir).selectExpr(
        *PAIR_KEY, f"{years1} AS years1", f"{years1} - {years2} AS years_gap"
    )


@query
def sex_code(spark, sf_dir):
    code = pf.sex_code("sex1", "sex2")
    return _profiled_edges(spark, sf_dir).selectExpr(*PAIR_KEY, f"{code} AS sex_code")


@query
def created_close(spark, sf_dir):
    close = pf.created_close("create_ms1", "create_ms2")
    return _profiled_edges(spark, sf_dir).selectExpr(*PAIR_KEY, f"{close} AS created_close")


@query
def log_profile_age(spark, sf_dir):
    def smaller(reference_ms):
        ages = [pf.log_age(f"create_ms{n}", reference_ms) for n in "12"]
        return f"round(least({', '.join(ages)}), 6)"

    return _profiled_edges(spark, sf_dir).selectExpr(
        *PAIR_KEY,
        f"{smaller(pf.REFERENCE_MS)} AS log_age",
        f"{smaller(pf.REFERENCE_MS_PARITY)} AS log_age_parity",
    )


@query
def place_match(spark, sf_dir):
    places = [("country", "country"), ("location", "location"), ("login_region", "region")]
    return _profiled_edges(spark, sf_dir).selectExpr(
        *PAIR_KEY, *[f"{pf.same_place(f'{c}1', f'{c}2')} AS same_{name}" for c, name in places]
    )


@query
def profile_pairs(spark, sf_dir):
    return _profiled_edges(spark, sf_dir, fx.some_profiles)


def _feature_columns(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return _wide(spark, sf_dir).select(*PAIR_KEY, "label", *columns)


@query
def aa_features(spark, sf_dir):
    return _labeled(spark, sf_dir).select(*PAIR_KEY, "label", *feat.SCORE_FEATURES)


@query
def user_features(spark, sf_dir):
    wide = _feature_columns(spark, sf_dir, feat.PROFILE_FEATURES)
    return wide.withColumn("log_age", F.round("log_age", 6))


@query
def type_features(spark, sf_dir):
    counted = feat.with_relation_counts(_labeled(spark, sf_dir))
    return counted.select(*PAIR_KEY, "label", *feat.RELATION_FEATURES)


@query
def parity_features(spark, sf_dir):
    settings = replace(run.PARITY, hub_degree=HUB_DEGREE)
    wide = run.wide_pairs(_edges(spark, sf_dir), fx.all_profiles(spark, sf_dir), settings)
    return wide.select(
        *PAIR_KEY, "label", *feat.RELATION_FEATURES, F.round("log_age", 6).alias("log_age")
    )


# -- recommendations by raw score ------------------------------------------


@query
def symmetric_scores(spark, sf_dir):
    return rec.both_directions(_pairs(spark, sf_dir), "score")


@query
def score_merge(spark, sf_dir):
    labeled = stored(feat.with_relation_counts(_labeled(spark, sf_dir)), "labeled")
    parts = [
        stored(labeled.select(*PAIR_KEY, F.col(c).alias(name)), name)
        for c, name in [("score", "p_aa"), ("n_school", "p_type"), ("n_family", "p_user")]
    ]
    return models.merge_scores(labeled.select(*PAIR_KEY, "label"), *parts)


def _top_strangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    pairs = run.candidate_pairs(edges, SETTINGS)
    strangers = labels.non_friends(labels.test_pairs(pairs), edges)
    directed = rec.both_directions(strangers, "score")
    return rec.top_k(rec.for_holdout(directed, cand.MIN_SCORE), TOP)


@query
def topk_recommendations(spark, sf_dir):
    return _top_strangers(spark, sf_dir)


@query
def recommendation_lists(spark, sf_dir):
    ranked = rec.top_k(rec.both_directions(_pairs(spark, sf_dir), "score"), TOP)
    return rec.suggestion_lists(ranked).select(
        "user_id", F.size("friends").alias("n"), F.concat_ws(",", "friends").alias("friends")
    )


@query
def recommendation_lines(spark, sf_dir):
    ranked = rec.top_k(rec.both_directions(_pairs(spark, sf_dir), "score"), TOP)
    path = fresh_path(spark, "recommendations")
    text.write_recommendations(rec.suggestion_lists(ranked), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# -- quality ---------------------------------------------------------------


def _rounded(curve: DataFrame) -> DataFrame:
    return curve.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "fbeta")})


@query
def fbeta_curve(spark, sf_dir):
    return _rounded(ev.fbeta_curve(stored(_labeled(spark, sf_dir), "labeled"), "score"))


@query
def fbeta_curve_binned(spark, sf_dir):
    labeled = stored(_labeled(spark, sf_dir), "labeled")
    return _rounded(ev.fbeta_curve(labeled, "score", num_bins=100))


@query
def best_threshold(spark, sf_dir):
    labeled = stored(_labeled(spark, sf_dir), "labeled")
    rows = [
        ev.best_threshold(ev.fbeta_curve(labeled, "score", beta)).select(
            F.lit(beta).alias("beta"), "threshold", F.round("fbeta", 6).alias("fbeta")
        )
        for beta in BETAS
    ]
    return reduce(DataFrame.union, rows)


@query
def auc_roc(spark, sf_dir):
    auc = ev.auc_roc(stored(_labeled(spark, sf_dir), "labeled"), "score")
    return auc.select(F.round("auc", 6).alias("auc"))


def _per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with ``mean``, a score of all decimals: the score over the kinds of relation."""
    counted = feat.with_relation_counts(_labeled(spark, sf_dir))
    kinds = " + ".join(feat.RELATION_FEATURES)
    return stored(counted.selectExpr("label", f"score / (1 + {kinds}) AS mean"), "per_kind")


@query
def fbeta_curve_exact(spark, sf_dir):
    """The curve over scores that differ in any decimal."""
    return _rounded(ev.fbeta_curve(_per_kind(spark, sf_dir), "mean", digits=None))


@query
def auc_exact(spark, sf_dir):
    auc = ev.auc_roc(_per_kind(spark, sf_dir), "mean", digits=None)
    return auc.select(F.round("auc", 9).alias("auc"))


# -- models ----------------------------------------------------------------


def _base_split(wide: DataFrame) -> DataFrame:
    return labels.train_pairs(wide).where(F.col("split") == labels.BASE)


@query
def lr_weight(spark, sf_dir):
    labeled = labels.with_split(_labeled(spark, sf_dir))
    base = stored(_base_split(labeled), "base_split")
    model = models.fit(base, feat.SCORE_FEATURES, models.logistic_regression())
    weight = float(model.stages[-1].coefficients[0])
    return base.agg(F.count("*").alias("n_pairs"), F.round(F.lit(weight), 3).alias("weight"))


@query
def lr_scores(spark, sf_dir):
    labeled = stored(labels.with_split(_labeled(spark, sf_dir)), "labeled")
    base = _base_split(labeled)
    model = models.fit(base, feat.SCORE_FEATURES, models.logistic_regression(tol=SHARP_TOL))
    scored = models.add_score(model, labeled, "p_aa").withColumn("p_aa", F.round("p_aa", 6))
    return scored.select(*PAIR_KEY, "label", "score", "p_aa")


@query
def tree_scores(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    base, scored = _base_split(wide), wide
    for name in ("type", "user"):
        model = models.fit(base, feat.FEATURE_SETS[name], models.decision_tree())
        scored = models.add_score(model, scored, f"p_{name}")
    return scored.select(*PAIR_KEY, "label", "p_type", "p_user")


@query
def tree_audit(spark, sf_dir):
    """Every node of both trees next to counts and gains from the rows that reach it."""
    base = stored(_base_split(_wide(spark, sf_dir)), "base_split")
    rows = []
    for name in ("type", "user"):
        model = models.fit(base, feat.FEATURE_SETS[name], models.decision_tree())
        nodes = models.tree_nodes(model)
        told = models.recounted(nodes, models.paths(model, base, nodes, PAIR_KEY))
        rows.append(told.drop("categories").withColumn("tree", F.lit(name)))
    return reduce(DataFrame.unionByName, rows)


@query
def stacked_scores(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    model = models.fit_stacked(labels.train_pairs(wide))
    held = labels.train_pairs(wide).where(F.col("split") == labels.VALIDATION)
    return model.transform(held).select(*PAIR_KEY, "label", *models.STACKED_SCORES, models.STACKED)


@query
def validation_report(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    model = models.fit_stacked(labels.train_pairs(wide))
    return run.validate(model, wide)


@query
def recommend_end_to_end(spark, sf_dir):
    return run.recommend(fx.edges(spark, sf_dir), fx.all_profiles(spark, sf_dir), SETTINGS)


@query
def recommend_text_to_text(spark, sf_dir):
    """The whole run on lines in files; the lines that it writes, read back."""
    lists, profiles, lines = (fresh_path(spark, n) for n in ("lists", "profiles", "lines"))
    fx.adjacency_text(spark, sf_dir).write.text(lists)
    fx.profile_text(spark, sf_dir).write.text(profiles)
    run.recommend_text(spark, lists, profiles, lines, SETTINGS)
    return spark.read.text(lines).select(F.col("value").alias("line"))
