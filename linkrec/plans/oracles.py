"""The named queries once more, as plain SQL for an independent engine.

Written from the definitions, pair by pair, with no regard for scale: every
wedge is enumerated, and relation masks are given as numbers.
"""

from __future__ import annotations

# Fixed values: (bucket code, raw types in the bucket, raw types whose main
# bucket it is, counter offset, typed weight), in order of priority.
BUCKETS = [
    ("close_family", 2, 316, 60, 3, 0.0),
    ("close_friends", 4, 270, 258, 6, 0.1),
    ("family", 1, 997628, 997568, 0, 1.0),
    ("school", 8, 1026, 1024, 9, 0.6),
    ("work", 16, 512, 512, 12, 0.3),
    ("university", 32, 16384, 16384, 15, 0.5),
    ("army", 64, 32768, 32768, 18, 0.4),
    ("play", 128, 1048576, 1048576, 21, 0.7),
]
# Fixed values: (kept, reverse) bits of the directed relations.
DIRECTED = [(8, 16), (64, 2048), (8192, 4096), (65536, 131072), (262144, 524288)]


def _full(m: str) -> str:
    return "(" + " + ".join(f"if(({m} & {f}) <> 0, {c}, 0)" for _, c, f, _, _, _ in BUCKETS) + ")"


def _main(m: str) -> str:
    return "(" + " + ".join(f"if(({m} & {s}) <> 0, {c}, 0)" for _, c, _, s, _, _ in BUCKETS) + ")"


def _first(b: str) -> str:
    cases = " ".join(f"WHEN ({b} & {c}) <> 0 THEN {c}" for _, c, _, _, _, _ in BUCKETS)
    return f"(CASE {cases} ELSE 0 END)"


def _combine(m1: str, m2: str) -> str:
    same = " ".join(f"WHEN ({m1} & {s}) <> 0 THEN {c}" for _, c, _, s, _, _ in BUCKETS)
    both = " ".join(
        f"WHEN ({m1} & {f}) <> 0 AND ({m2} & {f}) <> 0 THEN {c}" for _, c, f, _, _, _ in BUCKETS
    )
    return (
        f"(CASE WHEN {m1} = 0 OR {m2} = 0 THEN 0 "
        f"WHEN {m1} = {m2} THEN (CASE {same} ELSE 0 END) ELSE (CASE {both} ELSE 0 END) END)"
    )


def _canonical(m: str) -> str:
    for kept, reverse in DIRECTED:
        m = f"(({m} & (~{kept | reverse})) | if(({m} & {kept | reverse}) <> 0, {kept}, 0))"
    return m


def _swapped(m: str) -> str:
    pairs = " + ".join(
        f"if((raw_mask & {a}) <> 0, {b}, 0) + if((raw_mask & {b}) <> 0, {a}, 0)"
        for a, b in DIRECTED
    )
    rest = ~sum(a | b for a, b in DIRECTED)
    return f"(({m} & ({rest})) + {pairs})"


def _typed(b: str) -> str:
    extra = " + ".join(f"if(({b} & {c}) <> 0, {w}, 0.0)" for _, c, _, _, _, w in BUCKETS)
    return f"cast(1.0 + {extra} AS DOUBLE)"


def _int(e: str, name: str) -> str:
    return f"cast({e} AS INTEGER) AS {name}"


FRIEND = """CASE WHEN l_partkey % 23 = 0 THEN l_suppkey % 4
         WHEN l_partkey % 3 = 0 THEN (o_custkey // 10) * 10 + l_partkey % 12
         ELSE (o_custkey // 40) * 40 + l_partkey % 60 END"""
STAR = "10000000 + l_partkey % 200"
FAME = "20000000 + (l_partkey % 1000) * (l_partkey % 1000) * (l_partkey % 1000) // 5000000"


def _raw(friend: str) -> str:
    return f"""
listed AS (
  SELECT o_custkey AS user_id, {friend} AS friend_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
raw AS (
  SELECT user_id, friend_id, cast(
      CASE WHEN (user_id * 13 + friend_id * 29) % 24 < 4 THEN 0
           ELSE 1::BIGINT << ((user_id * 13 + friend_id * 29) % 24 - 3) END
      | CASE WHEN (user_id + friend_id) % 5 = 0 THEN 256 ELSE 0 END
      | CASE WHEN (user_id // 40) % 7 = 3 THEN 1024 ELSE 0 END
      | (user_id + friend_id) % 2 AS INTEGER) AS raw_mask
  FROM (SELECT DISTINCT user_id, friend_id FROM listed)
  WHERE user_id <> friend_id),
edges AS (
  SELECT user_id, friend_id, cast(raw_mask - raw_mask % 2 AS INTEGER) AS mask FROM raw)"""


def _members(friend: str) -> str:
    return f"""{_raw(friend)},
active AS (
  SELECT * FROM edges WHERE user_id IN
    (SELECT user_id FROM edges GROUP BY user_id HAVING count(*) >= 2)),
reversed AS (
  SELECT friend_id AS mid_id, user_id AS member_id, {_int(_canonical("mask"), "mask")}
  FROM active),
members AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mid_id) AS degree FROM reversed)
  WHERE degree >= 2)"""


def _wedges(friend: str) -> str:
    return f"""{_members(friend)},
wedge AS (
  SELECT a.member_id AS user1, b.member_id AS user2, a.mid_id, a.degree,
    {_int(_combine("a.mask", "b.mask"), "bucket")}
  FROM members a JOIN members b ON a.mid_id = b.mid_id AND a.member_id < b.member_id)"""


RAW, MEMBERS, WEDGES = _raw(FRIEND), _members(FRIEND), _wedges(FRIEND)

_COUNTS = ",\n    ".join(
    f"cast(least(count(*) FILTER (bucket = {c}), 7) AS INTEGER) AS n_{n}"
    for n, c, _, _, _, _ in BUCKETS
)


def _pairs(weight: str = "1.0", friend: str = FRIEND, least: float = 1.5) -> str:
    return f"""{_wedges(friend)},
pairs AS (
  SELECT * FROM (
    SELECT user1, user2, round(sum({weight} / ln(degree)), 6) AS score,
    {_COUNTS}
    FROM wedge GROUP BY user1, user2)
  WHERE score >= {least})"""


PAIRS = _pairs()
_PACKED = " + ".join(f"(n_{n} << {o})" for n, _, _, _, o, _ in BUCKETS)
_DOUBLED = " + ".join(f"(least(2 * n_{n}, 7) << {o})" for n, _, _, _, o, _ in BUCKETS)
_ONE = " ".join(f"WHEN {c} THEN {1 << o}" for _, c, _, _, o, _ in BUCKETS)

LABELED = f"""{PAIRS},
labeled AS (
  SELECT pairs.*, cast(if(friend_id IS NULL, 0, 1) AS DOUBLE) AS label
  FROM pairs LEFT JOIN edges ON user1 = user_id AND user2 = friend_id)"""

SPLIT = "((user1 % 1000003) * 7919 + (user2 % 1000003) * 104729 + 343983) % 1000003"
KNOWN = "user1 % 11 <> 7 AND user2 % 11 <> 7"
BOTH = """(SELECT user1 AS user_id, user2 AS friend_id, score FROM pairs
  UNION ALL SELECT user2, user1, score FROM pairs)"""

ALL_PROFILES = """
all_profiles AS (
  SELECT c_custkey AS user_id, coalesce(epoch_ms(first_date), 0) AS create_ms,
    cast(trunc(c_acctbal) AS INTEGER) AS age_days, cast(c_custkey % 3 AS INTEGER) AS sex,
    cast(c_nationkey AS BIGINT) AS country, cast(n_regionkey AS BIGINT) AS location,
    c_custkey % 5 AS login_region
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_date FROM orders GROUP BY o_custkey)
    ON c_custkey = o_custkey)"""
PROFILES = f"""{ALL_PROFILES},
some_profiles AS (SELECT * FROM all_profiles WHERE user_id % 13 <> 5)"""

_FIELDS = ["create_ms", "age_days", "sex", "country", "location", "login_region"]
_BOTH_PROFILES = ", ".join(
    f"coalesce({p}.{f}, 0) AS {f}{n}" for n, p in (("1", "a"), ("2", "b")) for f in _FIELDS
)


def _profiled(pairs: str, profiles: str = "all_profiles") -> str:
    return f"""{PROFILES},
profiled AS (
  SELECT p.*, {_BOTH_PROFILES} FROM {pairs} p
  LEFT JOIN {profiles} a ON user1 = a.user_id LEFT JOIN {profiles} b ON user2 = b.user_id)"""


FORWARD = f"""{RAW},
forward AS (
  SELECT user_id AS user1, friend_id AS user2 FROM edges WHERE friend_id > user_id)"""
PROFILED_EDGES = f"{FORWARD},\n{_profiled('forward')}"

_YEARS1 = "cast(trunc(age_days1 / 365.0) AS INTEGER)"
_YEARS2 = "cast(trunc(age_days2 / 365.0) AS INTEGER)"
_SEX = """CASE WHEN sex1 = 0 OR sex2 = 0 THEN -1 WHEN sex1 = sex2 AND sex1 = 1 THEN 1
  WHEN sex1 = sex2 THEN 2 WHEN sex1 = 1 THEN 3 ELSE 4 END"""
_CLOSE = "if(abs(create_ms1 - create_ms2) <= 7 * 86400000, 1, 0)"


def _log_age(reference: int) -> str:
    return f"""round(least(ln(greatest({reference} - create_ms1, 1)),
      ln(greatest({reference} - create_ms2, 1))), 6)"""


def _same(field: str) -> str:
    return f"""CASE WHEN {field}1 = 0 OR {field}2 = 0 THEN -1
      WHEN {field}1 = {field}2 THEN 1 ELSE 0 END"""


_PLACES = ", ".join(
    _int(_same(f), f"same_{n}")
    for f, n in [("country", "country"), ("location", "location"), ("login_region", "region")]
)
_RELATION_FEATURES = ", ".join(
    f"n_{b}"
    for b in [
        "close_friends", "family", "close_family", "school", "work", "university", "army", "play",
    ]
)


def _curve(beta: float) -> str:
    b2 = beta * beta
    return f"""
    SELECT {beta} AS beta, threshold, tp, fp, tp / (tp + fp) AS "precision", tp / p AS recall,
      {1 + b2} * tp / ({1 + b2} * tp + {b2} * (p - tp) + fp) AS fbeta, n, n_all
    FROM totals"""


def _totals(source: str, score: str) -> str:
    return f"""totals AS (
  SELECT {score} AS threshold,
    cast(sum(sum(label)) OVER down AS BIGINT) AS tp,
    cast(sum(sum(1 - label)) OVER down AS BIGINT) AS fp,
    cast(sum(label) AS BIGINT) AS own_tp, cast(sum(1 - label) AS BIGINT) AS own_fp,
    sum(sum(label)) OVER () AS p, sum(sum(1 - label)) OVER () AS q,
    row_number() OVER down AS n, count(*) OVER () AS n_all
  FROM {source} GROUP BY {score} WINDOW down AS (ORDER BY {score} DESC))"""


TOTALS = f"{LABELED},\n{_totals('labeled', 'score')}"
_KINDS = _RELATION_FEATURES.replace(", ", " + ")
EXACT_TOTALS = f"""{LABELED},
per_kind AS (SELECT label, score / (1 + {_KINDS}) AS mean FROM labeled),
{_totals("per_kind", "mean")}"""
_POINT = """threshold, tp, fp, round("precision", 6) AS "precision", round(recall, 6) AS recall,
  round(fbeta, 6) AS fbeta"""


def _newton(steps: int) -> str:
    """The weight of a one-feature logistic regression, by Newton's method."""
    ctes = ["w0 AS (SELECT 0.0::DOUBLE AS w)"]
    for i in range(steps):
        ctes.append(
            f"""w{i + 1} AS MATERIALIZED (
  SELECT any_value(w) + sum(score * (label - 1 / (1 + exp(-w * score))))
    / sum(score * score * exp(-w * score) / pow(1 + exp(-w * score), 2)) AS w
  FROM base, w{i})"""
        )
    return ",\n".join(ctes)


_FITTED = f"""{LABELED},
base AS (SELECT score, label FROM labeled WHERE {KNOWN} AND {SPLIT} < 700002),
{_newton(8)}"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_MASK2 = """edges2 AS (SELECT *, cast(CASE WHEN (user_id + friend_id) % 3 = 0 THEN mask
  ELSE (2::BIGINT << ((user_id + 3 * friend_id) % 20))
    | (2::BIGINT << ((2 * user_id + friend_id) % 20)) END AS INTEGER) AS mask2 FROM edges)"""
_PAIR_WEDGES = "FROM wedge JOIN pairs USING (user1, user2)"

_STRANGERS = f"""strangers AS (SELECT user1, user2, score FROM labeled
  WHERE label = 0 AND NOT ({KNOWN})),
directed AS (SELECT user1 AS user_id, user2 AS friend_id, score FROM strangers
  UNION ALL SELECT user2, user1, score FROM strangers),
ranked AS (SELECT *, cast(row_number() OVER
    (PARTITION BY user_id ORDER BY score DESC, friend_id) AS INTEGER) AS "rank"
  FROM directed WHERE user_id % 11 = 7)"""
_RANKED = f"""ranked AS (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY score DESC, friend_id) AS rnk FROM {BOTH})"""

ORACLES: dict[str, str] = {
    "adjacency_parse": _with(RAW, "SELECT * FROM edges"),
    "adjacency_rejects": r"""SELECT CASE c_custkey % 7
        WHEN 0 THEN c_custkey || chr(9) || '{}'
        WHEN 1 THEN c_custkey || chr(9) || '{(5,x)}'
        WHEN 2 THEN 'u' || c_custkey || chr(9) || '{(5,16)}'
        ELSE c_custkey || '' END AS value
      FROM customer WHERE c_custkey % 7 < 4""",
    "adjacency_sorted": """SELECT if(c_custkey % 7 < 4, 'rejected', 'whole') AS kind,
        count(*) AS n_lines,
        cast(sum(CASE c_custkey % 7 WHEN 0 THEN length(c_custkey || '') + 3
          WHEN 1 THEN length(c_custkey || '') + 8 WHEN 2 THEN length(c_custkey || '') + 10
          WHEN 3 THEN length(c_custkey || '') ELSE c_custkey + 8 END) AS BIGINT) AS total
      FROM customer GROUP BY kind""",
    "profile_parse": _with(ALL_PROFILES, "SELECT * FROM all_profiles"),
    "profile_rejects": """SELECT CASE c_custkey % 5
        WHEN 0 THEN chr(9) || c_custkey || chr(9) || '9'
        ELSE c_custkey || chr(9) || 'soon' || chr(9) || '9' END AS value
      FROM customer WHERE c_custkey % 5 < 2""",
    "profile_latest": """SELECT user_id, create_ms, age_days, sex, country, location, login_region
      FROM (SELECT o_custkey AS user_id, epoch_ms(o_orderdate) AS create_ms,
        cast(o_orderkey % 20000 AS INTEGER) AS age_days, cast(o_orderkey % 3 AS INTEGER) AS sex,
        cast(c_nationkey AS BIGINT) AS country, o_orderkey % 7 AS location,
        o_orderkey % 5 AS login_region, row_number() OVER
          (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey)
      WHERE n = 1""",
    "mask_normalize": _with(
        RAW, "SELECT user_id, friend_id, cast((raw_mask >> 1) << 1 AS INTEGER) AS mask FROM raw"
    ),
    "mask_invert": _with(
        RAW,
        f"""SELECT user_id, friend_id, {_int(_canonical("raw_mask"), "canonical")},
        {_int(_swapped("raw_mask"), "swapped")} FROM raw""",
    ),
    "mask_buckets": _with(
        RAW,
        f"""SELECT user_id, friend_id, {_int(_full("mask"), "full_buckets")},
        {_int(_main("mask"), "main_buckets")}, {_int(_first(_full("mask")), "first_full")},
        {_int(_first(_main("mask")), "first_main")} FROM edges""",
    ),
    "mask_combine": _with(
        f"{RAW},\n{_MASK2}",
        f"""SELECT user_id, friend_id, {_int(_combine("mask", "mask2"), "bucket")},
        {_int(_combine("mask2", "mask"), "bucket_swapped")} FROM edges2""",
    ),
    "typed_weight": _with(
        f"{RAW},\n{_MASK2}",
        f"""SELECT user_id, friend_id, round({_typed(_combine("mask", "mask2"))}, 6) AS weight,
        round({_typed(_full("mask"))}, 6) AS full_weight FROM edges2""",
    ),
    "reverse_edges": _with(
        RAW,
        f"""SELECT friend_id AS mid_id, user_id AS member_id,
        {_int(_canonical("mask"), "mask")} FROM edges""",
    ),
    "active_owner_edges": _with(MEMBERS, "SELECT * FROM active"),
    "busy_owner_edges": _with(
        RAW,
        """SELECT * FROM edges WHERE user_id IN
        (SELECT user_id FROM edges GROUP BY user_id HAVING count(*) >= 14)""",
    ),
    "list_owners": _with(RAW, "SELECT DISTINCT user_id FROM edges"),
    "group_members": _with(MEMBERS, "SELECT * FROM members"),
    "reverse_groups": _with(
        MEMBERS,
        """SELECT mid_id, cast(0 AS INTEGER) AS chunk, degree,
        string_agg(member_id || ':' || mask, ' ' ORDER BY member_id) AS members
        FROM members GROUP BY mid_id, degree""",
    ),
    "reverse_groups_chunked": _with(
        MEMBERS,
        """SELECT mid_id, chunk, degree,
        string_agg(member_id || ':' || mask, ' ' ORDER BY member_id) AS members
        FROM (SELECT *, cast((row_number() OVER (PARTITION BY mid_id ORDER BY member_id) - 1)
          // 50 AS INTEGER) AS chunk FROM members)
        GROUP BY mid_id, chunk, degree""",
    ),
    "groups_exploded": _with(MEMBERS, "SELECT * FROM members"),
    "wedges": _with(WEDGES, "SELECT bucket, count(*) AS n_wedges FROM wedge GROUP BY bucket"),
    "wedge_scores": _with(
        WEDGES,
        f"""SELECT degree, bucket, count(*) AS n_wedges,
        round(1.0 / ln(degree), 6) AS flat_weight,
        round({_typed("bucket")} / ln(degree), 6) AS typed_weight
        FROM wedge GROUP BY degree, bucket""",
    ),
    "pair_wedges": _with(
        PAIRS,
        f"""SELECT user1, user2, mid_id, degree, bucket,
        round({_typed("bucket")} / ln(degree), 6) AS weight {_PAIR_WEDGES}""",
    ),
    "pair_scores": _with(PAIRS, "SELECT user1, user2, score FROM pairs"),
    "hub_pair_scores": _with(
        _pairs(friend=STAR, least=2.5),
        f"SELECT user1, user2, score, {_int(_PACKED, 'packed')} FROM pairs",
    ),
    "fame_pair_scores": _with(
        _pairs(friend=FAME, least=2.5),
        f"SELECT user1, user2, score, {_int(_PACKED, 'packed')} FROM pairs",
    ),
    "typed_pair_scores": _with(
        _pairs(_typed("bucket")), "SELECT user1, user2, score FROM pairs"
    ),
    "pair_bucket_counts": _with(PAIRS, "SELECT * EXCLUDE (score) FROM pairs"),
    "packed_counters": _with(
        PAIRS,
        f"""SELECT user1, user2, {_int(_PACKED, "packed")}, n_school AS school, n_play AS play,
        {_int(_DOUBLED, "doubled")},
        {_int("CASE " + _first("(user1 % 256)") + " " + _ONE + " ELSE 0 END", "one")}
        FROM pairs""",
    ),
    "uncounted_close_family": _with(
        PAIRS,
        f"""SELECT user1, user2, cast(0 AS INTEGER) AS n_close_family,
        {_int(_PACKED + " - (n_close_family << 3)", "packed")} FROM pairs""",
    ),
    "pair_slice": _with(
        PAIRS, "SELECT user1, user2, score FROM pairs WHERE user1 % 70 = 7"
    ),
    "pair_store_roundtrip": _with(
        PAIRS,
        f"""SELECT user1, user2, score, {_int(_PACKED, "packed")},
        {_int("user1 % 70", "slice")} FROM pairs""",
    ),
    "positive_pairs": _with(
        RAW,
        """SELECT user_id AS user1, friend_id AS user2, cast(1 AS DOUBLE) AS label FROM edges
        WHERE friend_id > user_id AND friend_id IN (SELECT user_id FROM edges)""",
    ),
    "labeled_pairs": _with(LABELED, "SELECT user1, user2, score, label FROM labeled"),
    "non_friend_pairs": _with(
        LABELED, "SELECT user1, user2, score FROM labeled WHERE label = 0"
    ),
    "holdout_train": _with(PAIRS, f"SELECT user1, user2, score FROM pairs WHERE {KNOWN}"),
    "holdout_test": _with(PAIRS, f"SELECT user1, user2, score FROM pairs WHERE NOT ({KNOWN})"),
    "hash_split": _with(
        PAIRS,
        f"""SELECT user1, user2, {_int(
            f"CASE WHEN {SPLIT} < 700002 THEN 0 WHEN {SPLIT} < 900003 THEN 1 ELSE 2 END",
            "split")}
        FROM pairs WHERE {KNOWN}""",
    ),
    "age_features": _with(
        PROFILED_EDGES,
        f"""SELECT user1, user2, {_YEARS1} AS years1, {_YEARS1} - {_YEARS2} AS years_gap
        FROM profiled""",
    ),
    "sex_code": _with(
        PROFILED_EDGES, f"SELECT user1, user2, {_int(_SEX, 'sex_code')} FROM profiled"
    ),
    "created_close": _with(
        PROFILED_EDGES, f"SELECT user1, user2, {_int(_CLOSE, 'created_close')} FROM profiled"
    ),
    "log_profile_age": _with(
        PROFILED_EDGES,
        f"""SELECT user1, user2, {_log_age(1454284800000)} AS log_age,
        {_log_age(61414934400000)} AS log_age_parity FROM profiled""",
    ),
    "place_match": _with(PROFILED_EDGES, f"SELECT user1, user2, {_PLACES} FROM profiled"),
    "profile_pairs": _with(
        f"{FORWARD},\n{_profiled('forward', 'some_profiles')}", "SELECT * FROM profiled"
    ),
    "aa_features": _with(LABELED, "SELECT user1, user2, label, score FROM labeled"),
    "user_features": _with(
        f"{LABELED},\n{_profiled('labeled')}",
        f"""SELECT user1, user2, label, {_YEARS1} AS years1, {_YEARS1} - {_YEARS2} AS years_gap,
        {_int(_SEX, "sex_code")}, {_int(_CLOSE, "created_close")},
        {_log_age(1454284800000)} AS log_age, {_PLACES} FROM profiled""",
    ),
    "type_features": _with(
        LABELED, f"SELECT user1, user2, label, {_RELATION_FEATURES} FROM labeled"
    ),
    "parity_features": _with(
        f"{LABELED},\n{_profiled('labeled')}",
        f"""SELECT user1, user2, label, {_RELATION_FEATURES}, {_log_age(61414934400000)} AS log_age
        FROM (SELECT * REPLACE (cast(0 AS INTEGER) AS n_close_family) FROM profiled)""",
    ),
    "symmetric_scores": _with(PAIRS, f"SELECT * FROM {BOTH}"),
    "score_merge": _with(
        LABELED,
        """SELECT user1, user2, label, score AS p_aa, n_school AS p_type, n_family AS p_user
        FROM labeled""",
    ),
    "topk_recommendations": _with(
        f"{LABELED},\n{_STRANGERS}", 'SELECT * FROM ranked WHERE "rank" <= 5'
    ),
    "recommendation_lists": _with(
        f"{PAIRS},\n{_RANKED}",
        """SELECT user_id, cast(count(*) AS INTEGER) AS n,
        string_agg(friend_id, ',' ORDER BY rnk) AS friends
        FROM ranked WHERE rnk <= 5 GROUP BY user_id""",
    ),
    "recommendation_lines": _with(
        f"{PAIRS},\n{_RANKED}",
        """SELECT user_id || chr(9) || string_agg(friend_id, chr(9) ORDER BY rnk) AS line
        FROM ranked WHERE rnk <= 5 GROUP BY user_id""",
    ),
    "fbeta_curve": _with(f"{TOTALS}, curve AS ({_curve(2.0)})", f"SELECT {_POINT} FROM curve"),
    "fbeta_curve_binned": _with(
        f"{TOTALS}, curve AS ({_curve(2.0)})",
        f"""SELECT {_POINT} FROM curve
        WHERE n_all // 100 < 2 OR n % (n_all // 100) = 0 OR n = n_all""",
    ),
    "best_threshold": _with(
        TOTALS
        + ", curve AS ("
        + " UNION ALL ".join(_curve(b) for b in (2.0, 0.5, 0.1))
        + "\n), best AS (SELECT *, row_number() OVER"
        " (PARTITION BY beta ORDER BY round(fbeta, 12) DESC, threshold DESC) AS rnk FROM curve)",
        """SELECT cast(beta AS DOUBLE) AS beta, threshold, round(fbeta, 6) AS fbeta
        FROM best WHERE rnk = 1""",
    ),
    "auc_roc": _with(
        TOTALS,
        """SELECT round(sum(own_fp * (tp - own_tp + tp) / 2.0) / any_value(p * q), 6) AS auc
        FROM totals""",
    ),
    "fbeta_curve_exact": _with(
        f"{EXACT_TOTALS}, curve AS ({_curve(2.0)})", f"SELECT {_POINT} FROM curve"
    ),
    "auc_exact": _with(
        EXACT_TOTALS,
        """SELECT round(sum(own_fp * (tp - own_tp + tp) / 2.0) / any_value(p * q), 9) AS auc
        FROM totals""",
    ),
    "lr_scores": _with(
        _FITTED,
        """SELECT user1, user2, label, score, round(1 / (1 + exp(-w * score)), 6) AS p_aa
  FROM labeled, w8""",
    ),
    "lr_weight": _with(
        _FITTED,
        "SELECT (SELECT count(*) FROM base) AS n_pairs, round(w, 3) AS weight FROM w8",
    ),
}
