"""Relation bitmasks as SQL expressions.

Each function takes SQL expressions (most often column names) and returns one,
for use in ``selectExpr`` or ``expr``.  Text is parsed once per expression,
where nested Column calls cost a round trip to the JVM for every operator.

A friendship carries an int mask: bit 0 is noise, bits 1..20 are raw relation
types.  Two friendships that meet at one person are combined into one of eight
buckets (family, school, ...), and buckets are counted per pair.
"""

from __future__ import annotations

# Raw relation types by bit, with every bucket a type belongs to
# and its one main bucket.
RELATION_TYPES = [
    # bit, name, all buckets, main bucket
    (1, "LOVE", ["CLOSE_FRIENDS", "SCHOOL"], "CLOSE_FRIENDS"),
    (2, "SPOUSE", ["CLOSE_FAMILY", "FAMILY", "CLOSE_FRIENDS"], "CLOSE_FAMILY"),
    (3, "PARENT", ["CLOSE_FAMILY", "FAMILY", "CLOSE_FRIENDS"], "CLOSE_FAMILY"),
    (4, "CHILD", ["CLOSE_FAMILY", "FAMILY"], "CLOSE_FAMILY"),
    (5, "BROTHER_SISTER", ["CLOSE_FAMILY", "FAMILY"], "CLOSE_FAMILY"),
    (6, "UNCLE_AUNT", ["FAMILY"], "FAMILY"),
    (7, "RELATIVE", ["FAMILY"], "FAMILY"),
    (8, "CLOSE_FRIEND", ["CLOSE_FAMILY", "CLOSE_FRIENDS"], "CLOSE_FRIENDS"),
    (9, "COLLEAGUE", ["WORK"], "WORK"),
    (10, "SCHOOLMATE", ["SCHOOL"], "SCHOOL"),
    (11, "NEPHEW", ["FAMILY"], "FAMILY"),
    (12, "GRANDPARENT", ["FAMILY"], "FAMILY"),
    (13, "GRANDCHILD", ["FAMILY"], "FAMILY"),
    (14, "UNIVERSITY_FEL", ["UNIVERSITY"], "UNIVERSITY"),
    (15, "ARMY_FEL", ["ARMY"], "ARMY"),
    (16, "PARENT_IN_LAW", ["FAMILY"], "FAMILY"),
    (17, "CHILD_IN_LAW", ["FAMILY"], "FAMILY"),
    (18, "GODPARENT", ["FAMILY"], "FAMILY"),
    (19, "GODCHILD", ["FAMILY"], "FAMILY"),
    (20, "PLAY_TOGETHER", ["PLAY"], "PLAY"),
]

# Bucket codes and the bit offset of each bucket's 3-bit counter.
BUCKETS = {
    "FAMILY": 1,
    "CLOSE_FAMILY": 2,
    "CLOSE_FRIENDS": 4,
    "SCHOOL": 8,
    "WORK": 16,
    "UNIVERSITY": 32,
    "ARMY": 64,
    "PLAY": 128,
}
COUNTER_OFFSETS = {
    "FAMILY": 0,
    "CLOSE_FAMILY": 3,
    "CLOSE_FRIENDS": 6,
    "SCHOOL": 9,
    "WORK": 12,
    "UNIVERSITY": 15,
    "ARMY": 18,
    "PLAY": 21,
}
COUNTER_CAP = 7

# Which bucket wins when two friendships share several.
BUCKET_PRIORITY = [
    "CLOSE_FAMILY",
    "CLOSE_FRIENDS",
    "FAMILY",
    "SCHOOL",
    "WORK",
    "UNIVERSITY",
    "ARMY",
    "PLAY",
]

# What a shared bucket adds to the base weight in typed mode.
BASE_WEIGHT = 1.0
TYPED_WEIGHTS = {
    "FAMILY": 1.0,
    "CLOSE_FRIENDS": 0.1,
    "SCHOOL": 0.6,
    "WORK": 0.3,
    "UNIVERSITY": 0.5,
    "ARMY": 0.4,
    "PLAY": 0.7,
}

# Directed relations, each with its reverse.  The first name is
# the one both collapse to under canonical inversion.
DIRECTED = [
    ("PARENT", "CHILD"),
    ("UNCLE_AUNT", "NEPHEW"),
    ("GRANDCHILD", "GRANDPARENT"),
    ("PARENT_IN_LAW", "CHILD_IN_LAW"),
    ("GODPARENT", "GODCHILD"),
]

MASKS = {name: 1 << bit for bit, name, _, _ in RELATION_TYPES}

# Per bucket, the mask of raw types that feed it.
FULL_SOURCES = {
    b: sum(1 << bit for bit, _, full, _ in RELATION_TYPES if b in full) for b in BUCKETS
}
MAIN_SOURCES = {
    b: sum(1 << bit for bit, _, _, main in RELATION_TYPES if main == b) for b in BUCKETS
}


DIRECTED_BITS = sum(MASKS[a] | MASKS[b] for a, b in DIRECTED)


def _has(mask: str, bits: int) -> str:
    return f"({mask}) & {bits} <> 0"


def _flags(options: list[tuple[str, int]]) -> str:
    """OR of the values whose condition holds."""
    return "(" + " | ".join(f"if({condition}, {value}, 0)" for condition, value in options) + ")"


def normalize(mask: str) -> str:
    """Clear the noise bit."""
    return f"({mask}) - ({mask}) % 2"


def invert(mask: str, mode: str = "canonical") -> str:
    """The mask as seen from the other end of the friendship.

    ``canonical`` folds both directions of a relation into one type, so that a
    parent and a child look the same.  ``swap`` exchanges the two directions.
    """
    pairs = [(MASKS[a], MASKS[b]) for a, b in DIRECTED]
    if mode == "canonical":
        turned = _flags([(_has(mask, a | b), a) for a, b in pairs])
    elif mode == "swap":
        both_ways = pairs + [(b, a) for a, b in pairs]
        turned = _flags([(_has(mask, a), b) for a, b in both_ways])
    else:
        raise ValueError(f"unknown inversion mode: {mode}")
    return f"(({mask}) & {~DIRECTED_BITS} | {turned})"


def full_buckets(mask: str) -> str:
    """Every bucket the mask belongs to."""
    return _flags([(_has(mask, FULL_SOURCES[b]), code) for b, code in BUCKETS.items()])


def main_buckets(mask: str) -> str:
    """The main buckets of the mask's types."""
    return _flags([(_has(mask, MAIN_SOURCES[b]), code) for b, code in BUCKETS.items()])


def first_bucket(buckets: str) -> str:
    """The bucket of highest priority in a bucket mask, 0 if there is none."""
    codes = [BUCKETS[b] for b in BUCKET_PRIORITY]
    cases = " ".join(f"WHEN {_has(buckets, code)} THEN {code}" for code in codes)
    return f"CASE {cases} ELSE 0 END"


def combine(mask1: str, mask2: str) -> str:
    """The one bucket two friendships have in common, 0 if none.

    A mask of 0 belongs to no bucket, so it never matches.
    """
    main1 = first_bucket(main_buckets(mask1))
    return combine_prepared(mask1, mask2, main1, full_buckets(mask1), full_buckets(mask2))


def combine_prepared(mask1: str, mask2: str, main1: str, full1: str, full2: str) -> str:
    """``combine`` over per-friendship columns worked out beforehand."""
    shared = first_bucket(f"({full1}) & ({full2})")
    return f"CASE WHEN {mask1} = {mask2} THEN {main1} ELSE {shared} END"


def typed_weight(buckets: str) -> str:
    """Weight of a shared bucket mask from the fixed table."""
    extra = [f"if({_has(buckets, BUCKETS[b])}, {w}D, 0D)" for b, w in TYPED_WEIGHTS.items()]
    return f"({BASE_WEIGHT}D + {' + '.join(extra)})"


def edge_weight(bucket: str, weight: str = "flat") -> str:
    """Weight of one shared neighbour: ``flat`` (always 1) or ``typed``."""
    if weight == "flat":
        return f"{BASE_WEIGHT}D"
    if weight == "typed":
        return typed_weight(bucket)
    raise ValueError(f"unknown weight: {weight}")


def max_edge_weight(full: str, weight: str = "flat") -> str:
    """Largest ``edge_weight`` a friendship in these buckets can take part in."""
    if weight == "flat":
        return f"{BASE_WEIGHT}D"
    if weight == "typed":
        extra = [f"if({_has(full, BUCKETS[b])}, {w}D, 0D)" for b, w in TYPED_WEIGHTS.items()]
        return f"({BASE_WEIGHT}D + greatest({', '.join(extra)}))"
    raise ValueError(f"unknown weight: {weight}")


def count_name(bucket: str) -> str:
    return f"n_{bucket.lower()}"


COUNT_COLUMNS = [count_name(b) for b in BUCKETS]


def bucket_counter(bucket: str) -> str:
    """A packed counter holding 1 in the field of this bucket."""
    return _flags([(_has(bucket, c), 1 << COUNTER_OFFSETS[b]) for b, c in BUCKETS.items()])


def pack_counts(counts: dict[str, str]) -> str:
    """Pack per-bucket counts, each capped at 7, into one int."""
    fields = [
        f"shiftleft(cast(least({n}, {COUNTER_CAP}) AS INT), {COUNTER_OFFSETS[b]})"
        for b, n in counts.items()
    ]
    return "(" + " | ".join(fields) + ")"


def read_counter(packed: str, bucket: str) -> str:
    """The count of one bucket in a packed int."""
    offset = COUNTER_OFFSETS[bucket]
    return f"shiftright(({packed}) & {COUNTER_CAP << offset}, {offset})"


def merge_counters(packed1: str, packed2: str) -> str:
    """Field-wise sum of two packed ints, each field capped at 7."""
    return pack_counts(
        {b: f"{read_counter(packed1, b)} + {read_counter(packed2, b)}" for b in BUCKETS}
    )
