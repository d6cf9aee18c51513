"""Three feature sets of a pair: score, profiles, kinds of shared neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrec.functions.profiles import (
    REFERENCE_MS,
    created_close,
    log_age,
    same_place,
    sex_code,
    whole_years,
)
from linkrec.functions.relations import BUCKETS, count_name, read_counter
from linkrec.operators.skew import count_rows, hot_keys, salted_join
from linkrec.schemas import PROFILE_FIELDS

# Columns of each feature vector, in order.
SCORE_FEATURES = ["score"]
PROFILE_FEATURES = [
    "years1",
    "years_gap",
    "sex_code",
    "created_close",
    "log_age",
    "same_country",
    "same_location",
    "same_region",
]
RELATION_FEATURES = [
    count_name(b)
    for b in [
        "CLOSE_FRIENDS",
        "FAMILY",
        "CLOSE_FAMILY",
        "SCHOOL",
        "WORK",
        "UNIVERSITY",
        "ARMY",
        "PLAY",
    ]
]
FEATURE_SETS = {"aa": SCORE_FEATURES, "type": RELATION_FEATURES, "user": PROFILE_FEATURES}


def with_relation_counts(pairs: DataFrame) -> DataFrame:
    """Add the count per relation bucket, read from ``packed``."""
    counts = {count_name(b): F.expr(read_counter("packed", b)) for b in BUCKETS}
    return pairs.withColumns(counts)


def with_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add both users' profile fields (suffix 1 and 2); 0 where unknown.

    ``pairs`` should be a stored table."""
    sizes = {u: count_rows(pairs, u) for u in ("user1", "user2")}
    n_pairs = pairs.count()
    for n in ("1", "2"):
        user = f"user{n}"
        named = profiles.selectExpr(
            f"user_id AS {user}", *[f"{c} AS {c}{n}" for c in PROFILE_FIELDS]
        )
        other = "user2" if n == "1" else "user1"
        hot = hot_keys(sizes[user], user, total=n_pairs)
        joined = salted_join(pairs, named, [user], hot, [other], "left")
        pairs = joined.fillna(0, [f"{c}{n}" for c in PROFILE_FIELDS])
    return pairs


def profile_features(profiled: DataFrame, reference_ms: int = REFERENCE_MS) -> DataFrame:
    """Replace the fields of ``with_profiles`` by the profile features."""
    years1, years2 = whole_years("age_days1"), whole_years("age_days2")
    ages = [log_age(f"create_ms{n}", reference_ms) for n in "12"]
    columns = {
        "years1": years1,
        "years_gap": f"{years1} - {years2}",
        "sex_code": sex_code("sex1", "sex2"),
        "created_close": created_close("create_ms1", "create_ms2"),
        "log_age": f"least({', '.join(ages)})",
        "same_country": same_place("country1", "country2"),
        "same_location": same_place("location1", "location2"),
        "same_region": same_place("login_region1", "login_region2"),
    }
    return profiled.withColumns({name: F.expr(sql) for name, sql in columns.items()}).drop(
        *[f"{f}{n}" for f in PROFILE_FIELDS for n in "12"]
    )


def with_features(
    labeled: DataFrame, profiles: DataFrame, reference_ms: int = REFERENCE_MS
) -> DataFrame:
    """One wide frame with the columns of all three feature sets.

    Counts stay packed until the profiles are joined, to keep shuffles narrow.
    """
    profiled = profile_features(with_profiles(labeled, profiles), reference_ms)
    return with_relation_counts(profiled).drop("packed")
