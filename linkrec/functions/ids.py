"""SQL expressions on user ids: hold-out users, slices and repeatable splits."""

from __future__ import annotations

# Users whose id has this remainder are held out for testing.
HOLDOUT_MODULUS = 11
HOLDOUT_REMAINDER = 7
PAIR_SLICES = 70

# Split hash: a linear mix of both ids over a prime range.  Plain arithmetic,
# so that any SQL engine gives the same split.
SPLIT_RANGE = 1000003
SPLIT_FACTORS = (7919, 104729)
SEED_FACTOR = 15485863


def is_holdout(user: str) -> str:
    return f"(pmod({user}, {HOLDOUT_MODULUS}) = {HOLDOUT_REMAINDER})"


def id_slice(user: str, slices: int = PAIR_SLICES) -> str:
    return f"cast(pmod({user}, {slices}) AS INT)"


def split_hash(user1: str, user2: str, seed: int = 11) -> str:
    """A number in [0, SPLIT_RANGE) that depends only on the pair and the seed."""
    a = f"pmod({user1}, {SPLIT_RANGE}) * {SPLIT_FACTORS[0]}"
    b = f"pmod({user2}, {SPLIT_RANGE}) * {SPLIT_FACTORS[1]}"
    start = seed * SEED_FACTOR % SPLIT_RANGE
    return f"pmod({a} + {b} + {start}, {SPLIT_RANGE})"


def split_number(user1: str, user2: str, weights: list[float], seed: int = 11) -> str:
    """Number of the split (from 0) the pair falls in, by weights."""
    value, share, cases = split_hash(user1, user2, seed), 0.0, []
    for i, w in enumerate(weights[:-1]):
        share += w / sum(weights)
        cases.append(f"WHEN {value} < {round(share * SPLIT_RANGE)} THEN {i}")
    return f"CASE {' '.join(cases)} ELSE {len(weights) - 1} END"
