"""Hashes of text in packed form, dealt into buckets by their leading bits.

A bucket's rows are long byte strings of hashes, sorted and counted by numpy, so that a
hundred million of them move and meet as a few thousand rows.  Buckets are ranges of
hash values, so the bucket of a hash and the order of hashes agree.
"""

from __future__ import annotations

import numpy as np

BUCKET_BYTES = 16 << 20


def n_buckets(n_bytes: float, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for this many bytes of hashes, so that one stays within memory."""
    return max(1, -(-int(n_bytes) // bucket_bytes))


def filter_width(n_hashes: int) -> int:
    """Bytes that tell hashes apart well enough for a filter: one in 1,000 may collide."""
    return min(8, -(-(max(2, n_hashes).bit_length() + 10) // 8))


def shorten(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes >> np.uint64(64 - 8 * width)


def to_bytes(values: np.ndarray, width: int = 8) -> bytes:
    whole = np.ascontiguousarray(values.astype("<u8"))
    return whole.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_bytes(raw: bytes, width: int = 8) -> np.ndarray:
    if width == 8:
        return np.frombuffer(raw, "<u8")
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def edges(buckets: int, width: int = 8) -> np.ndarray:
    """First hash of each bucket but bucket 0, for searchsorted."""
    return np.array([(b << (8 * width)) // buckets for b in range(1, buckets)], np.uint64)


def slices(ordered: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that sorted hashes fall into."""
    at = [0, *np.searchsorted(ordered, cuts).tolist(), len(ordered)]
    return [(b, a, z) for b, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def run_totals(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each hash the sum of weights (or the number) of all equal ones."""
    order = np.argsort(hashes, kind="stable")
    starts = group_starts(hashes[order])
    sizes = np.diff(np.append(starts, len(hashes)))
    totals = sizes if weights is None else np.add.reduceat(weights[order], starts)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.repeat(totals, sizes)
    return out
