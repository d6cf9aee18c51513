"""Small-scale answers worked out pair by pair in Python."""

from collections import defaultdict
from itertools import combinations
from math import log

from linkrec.functions import relations as rel

# Relation types by name, read from the same fixed tables, applied one by one.
FULL = {1 << bit: set(full) for bit, _, full, _ in rel.RELATION_TYPES}
MAIN = {1 << bit: main for bit, _, _, main in rel.RELATION_TYPES}


def full(mask):
    return set().union(*[FULL[b] for b in FULL if mask & b], set())


def combine(m1, m2):
    if m1 == 0 or m2 == 0:
        return None
    shared = {MAIN[b] for b in MAIN if m1 & b} if m1 == m2 else full(m1) & full(m2)
    return next((b for b in rel.BUCKET_PRIORITY if b in shared), None)


def code(bucket):
    return rel.BUCKETS[bucket] if bucket else 0


def weight(bucket, mode):
    extra = rel.TYPED_WEIGHTS.get(bucket, 0.0) if mode == "typed" else 0.0
    return 1.0 + extra


def wedges(members):
    """members: (mid, member, mask) rows -> (u1, u2, mid, degree, bucket) rows."""
    groups = defaultdict(list)
    for mid, member, mask in members:
        groups[mid].append((member, mask))
    for mid, group in groups.items():
        for (u, m), (v, n) in combinations(sorted(group), 2):
            yield u, v, mid, len(group), combine(m, n)


def pairs(members, min_score, mode="flat"):
    scores, counts = defaultdict(float), defaultdict(lambda: defaultdict(int))
    for u, v, _, degree, bucket in wedges(members):
        scores[u, v] += weight(bucket, mode) / log(degree)
        counts[u, v][bucket] += 1
    return {
        key: (s, tuple(min(counts[key][b], 7) for b in rel.BUCKETS))
        for key, s in scores.items()
        if round(s, 6) >= min_score
    }
