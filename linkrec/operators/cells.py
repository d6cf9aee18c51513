"""Pairs that share much in large groups, where nearly every two users share something.

There the wedges outnumber the pairs of users many times, and to shuffle them by pair
costs far more than to work the pairs out.  Users are cut into blocks, and each two blocks
meet in a cell.  A cell has all that its users have in hubs, so what two of them share is
the product of two rows of a matrix of users by hubs; tiles of that product are compared
with the cut and forgotten.  Only pairs that could reach it are listed wedge by wedge, and
they leave as one row each, summed up.

An entry of the matrix is the square root of the most that a friendship can add to a
score, summed over repeated ones, so that the product is never below a pair's score.  It
is the score itself where weights are flat.  The product grows by a number of hubs at a
time.  What a user has in the hubs still to come bounds what any pair of that user can
gain from them, and a tile is left once none of its pairs can reach the cut, or so few
that they are listed at once.

Blocks travel in pieces, in which a membership takes a few bytes: the numbers of its hub
and of its mask among those of the piece.  A task holds one block spread out, and the
pieces of the other pass by one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrec.functions.relations import (
    BASE_WEIGHT,
    BUCKET_PRIORITY,
    BUCKETS,
    COUNT_COLUMNS,
    TYPED_WEIGHTS,
    first_bucket,
    full_buckets,
    main_buckets,
    max_edge_weight,
)
from linkrec.shipping import ship_package

# Memberships of a block and of a piece, about; users of a tile of the product.
BLOCK_ROWS = 4_000_000
PIECE_ROWS = 250_000
TILE = 512
# Hubs by which the product grows, and the share of a tile's pairs that are listed at once.
HUBS_AT_ONCE = 96
LISTED_SHARE = 1 / 1_024
# Memberships looked at at once when the wedges of found pairs are listed, and pairs that leave
# together.
LISTED_AT_ONCE = 250_000
SENT_AT_ONCE = 10_000
# Users times hubs up to which a block or piece is laid out as a table.
TABLE_SIZE = 1 << 24
# A product in single precision may miss a score by this share of it.
PRODUCT_ERROR = 1e-4

_PACKED = ("users", "sizes", "mids", "degrees", "place", "code", "masks", "mains", "fulls", "roots")
PACKED = "piece int, block int, " + ", ".join(f"{c} binary" for c in _PACKED)
FOUND = "user1 long, user2 long, score double, " + ", ".join(f"{c} int" for c in COUNT_COLUMNS)

# Buckets by number, and the number of the first of several.
_NUMBER = {code: i for i, code in enumerate(BUCKETS.values(), 1)}
_FIRST = np.array(
    [next((_NUMBER[BUCKETS[b]] for b in BUCKET_PRIORITY if s & BUCKETS[b]), 0) for s in range(256)],
    np.uint8,
)


def _numbers(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs."""
    kind = np.min_scalar_type(values.max(initial=0))
    return values.astype(kind.newbyteorder("<")).tobytes()


def _pack(table: pa.Table) -> pa.Table:
    """The memberships of a piece as one row, by user."""
    given = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.argsort(given["member_id"], kind="stable")
    users, sizes = np.unique(given["member_id"], return_counts=True)
    mids, hub, place = np.unique(given["mid_id"], return_index=True, return_inverse=True)
    masks, kind, code = np.unique(given["mask"], return_index=True, return_inverse=True)
    packed = {
        "users": users.astype("<i8").tobytes(),
        "sizes": _numbers(sizes),
        "mids": mids.astype("<i8").tobytes(),
        "degrees": given["degree"][hub].astype("<i8").tobytes(),
        "place": _numbers(place[order]),
        "code": _numbers(code[order]),
        "masks": masks.astype("<i4").tobytes(),
        "mains": given["main"][kind].astype("<i4").tobytes(),
        "fulls": given["full"][kind].astype("<i4").tobytes(),
        "roots": given["root"][kind].astype("<f8").tobytes(),
    }
    own = {c: pa.array([int(given[c][0])], pa.int32()) for c in ("piece", "block")}
    return pa.table(own | {c: pa.array([packed[c]], pa.binary()) for c in _PACKED})


def _unpack(row: dict) -> dict[str, np.ndarray]:
    of = lambda c, n: np.frombuffer(row[c], f"<u{len(row[c]) // n}")
    d = {c: np.frombuffer(row[c], "<i8") for c in ("users", "mids", "degrees")}
    d |= {c: np.frombuffer(row[c], "<i4") for c in ("masks", "mains", "fulls")}
    d |= {"roots": np.frombuffer(row["roots"], "<f8"), "sizes": of("sizes", len(d["users"]))}
    n_rows = int(d["sizes"].sum(dtype=np.int64))
    return d | {"place": of("place", n_rows), "code": of("code", n_rows)}


@dataclass
class _Hubs:
    """The hubs of a block, numbered in the order in which the product takes them."""

    mids: np.ndarray
    number: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, pieces: list[dict]) -> _Hubs:
        mids = np.unique(np.concatenate([d["mids"] for d in pieces]))
        degrees, n_rows = np.ones(len(mids), np.int64), np.zeros(len(mids))
        for d in pieces:
            at = np.searchsorted(mids, d["mids"])
            degrees[at] = d["degrees"]
            n_rows[at] += np.bincount(d["place"], minlength=len(at))
        # First those that tell most about a pair: those that half of the users are in.
        share = n_rows / sum(len(d["users"]) for d in pieces)
        order = np.argsort(-share * (1 - share), kind="stable")
        number = np.empty(len(mids), np.int32)
        number[order] = np.arange(len(mids))
        return cls(mids, number, np.log(degrees[order].astype(float)))

    def numbered(self, mids: np.ndarray) -> np.ndarray:
        """The numbers of ``mids``, -1 for hubs that are not among these."""
        at = np.minimum(np.searchsorted(self.mids, mids), len(self.mids) - 1)
        return np.where(self.mids[at] == mids, self.number[at], -1).astype(np.int32)


class _Side:
    """Memberships in ``hubs`` by user and hub, users who have most there first.

    Repeated ones count as one, with the sum of their entries; ``first`` and ``times`` lead
    to them.
    """

    def __init__(self, pieces: list[dict], hubs: _Hubs):
        self.n_hubs = n_hubs = len(hubs.mids)
        at, users, hub, value, kinds = 0, [], [], [], {"masks": [], "mains": [], "fulls": []}
        for d in pieces:
            number = hubs.numbered(d["mids"])[d["place"]]
            shared = np.flatnonzero(number >= 0)
            user = np.repeat(np.arange(at, at + len(d["users"]), dtype=np.int32), d["sizes"])
            code = d["code"][shared]
            users.append(user[shared])
            hub.append(number[shared])
            value.append(d["roots"][code] / np.sqrt(hubs.logs[hub[-1]]))
            for c, of in kinds.items():
                of.append(d[c].astype(np.int32 if c == "masks" else np.uint8)[code])
            at += len(d["users"])
        users, hub, value = (np.concatenate(x) for x in (users, hub, value))
        best = np.argsort(-np.bincount(users, value, at), kind="stable")
        self.users = np.concatenate([d["users"] for d in pieces])[best]
        rank = np.empty(at, np.int64)
        rank[best] = np.arange(at)
        key = rank[users] * n_hubs + hub
        del users, hub
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        self.masks, self.mains, self.fulls = (np.concatenate(x)[order] for x in kinds.values())
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.repeated = len(new) < len(key)
        if self.repeated:
            self.first, self.times = new, np.diff(new, append=len(key))
            key, value = key[new], np.add.reduceat(value, new)
        self.key, self.value = key, value.astype(np.float32)
        self.user, self.hub = (key // n_hubs).astype(np.int32), (key % n_hubs).astype(np.int32)
        self.sizes = np.bincount(self.user, minlength=at)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.most = np.zeros(n_hubs)
        np.maximum.at(self.most, self.hub, self.value)
        self.small = at * n_hubs <= TABLE_SIZE
        self.table, self.tiles = None, {}

    def gains(self, other: _Side) -> np.ndarray:
        """The most that each user can share with any of the ``other`` side."""
        return np.bincount(self.user, self.value * other.most[self.hub], len(self.users))

    def dense(self, tile: int, hub: int) -> np.ndarray:
        """A tile of users by hubs of the matrix."""
        if (tile, hub) in self.tiles:
            return self.tiles[tile, hub]
        n_users = min(TILE, len(self.users) - tile)
        n_hubs = min(HUBS_AT_ONCE, self.n_hubs - hub)
        a = self.starts[tile]
        z = self.starts[tile + n_users - 1] + self.sizes[tile + n_users - 1]
        hubs = self.hub[a:z]
        own = np.flatnonzero((hubs >= hub) & (hubs < hub + n_hubs))
        filled = np.zeros((n_users, n_hubs), np.float32)
        filled[self.user[a:z][own] - tile, hubs[own] - hub] = self.value[a:z][own]
        if self.small:
            self.tiles[tile, hub] = filled
        return filled

    def find(self, user: np.ndarray, hub: np.ndarray) -> np.ndarray:
        """Where these memberships are, -1 for those that are not."""
        key = user * self.n_hubs + hub
        if not self.small:
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            return np.where(self.key[at] == key, at, -1)
        if self.table is None:
            self.table = np.full(len(self.users) * self.n_hubs, -1, np.int32)
            self.table[self.key] = np.arange(len(self.key))
        return self.table[key]


class _Cell:
    """Scores of the pairs of users of one block or two."""

    def __init__(self, min_score: float, weight: str):
        self.least = min_score * (1 - PRODUCT_ERROR) if min_score > 0 else min_score - PRODUCT_ERROR
        extra = TYPED_WEIGHTS if weight == "typed" else {}
        self.weights = np.array([BASE_WEIGHT, *(BASE_WEIGHT + extra.get(b, 0.0) for b in BUCKETS)])
        self.room = np.empty((2, TILE, TILE), np.float32)
        self.hits = np.empty((2, TILE, TILE), bool)

    def _could(
        self, a: _Side, r: int, b: _Side, c: int, one: np.ndarray, two: np.ndarray, once: bool
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a tile that could reach the cut, of users who can share ``one`` and ``two``."""
        n, m = min(TILE, len(a.users) - r), min(TILE, len(b.users) - c)
        one, two = one[r : r + n].copy(), two[c : c + m].copy()
        none = np.empty(0, np.int64)
        if min(one.max(), two.max()) < self.least:
            return none, none
        total, more = self.room[0].ravel()[: n * m].reshape(n, m), self.room[1].ravel()[: n * m].reshape(n, m)
        hit, also = (x.ravel()[: n * m].reshape(n, m) for x in self.hits)
        for h in range(0, a.n_hubs, HUBS_AT_ONCE):
            x, y = a.dense(r, h), b.dense(c, h)
            np.matmul(x, y.T, out=more if h else total)
            if h:
                np.add(total, more, out=total)
            last = h + HUBS_AT_ONCE >= a.n_hubs
            one -= x @ b.most[h : h + HUBS_AT_ONCE]
            two -= y @ a.most[h : h + HUBS_AT_ONCE]
            if last:
                np.greater_equal(total, np.float32(self.least), out=hit)
            else:
                np.greater_equal(total, (self.least - one).astype(np.float32)[:, None], out=hit)
                np.greater_equal(total, (self.least - two).astype(np.float32), out=also)
                np.logical_and(hit, also, out=hit)
            left = np.count_nonzero(hit)
            if not left:
                return none, none
            if last or left <= LISTED_SHARE * n * m:
                break
        p, q = np.divmod(np.flatnonzero(hit), m)
        if once and r == c:
            p, q = p[p < q], q[p < q]
        return p + r, q + c

    def _scores(self, a: _Side, p: np.ndarray, b: _Side, q: np.ndarray, hubs: _Hubs) -> pa.RecordBatch:
        """Scores and counts of the users ``p`` of one side with ``q`` of the other."""
        n, sizes = len(p), a.sizes[p]
        ends = np.cumsum(sizes)
        row = np.arange(sizes.sum()) + np.repeat(a.starts[p] - (ends - sizes), sizes)
        pair = np.repeat(np.arange(n), sizes)
        other = b.find(q[pair], a.hub[row])
        met = np.flatnonzero(other >= 0)
        row, other, pair = row[met], other[met], pair[met]
        logs = hubs.logs[a.hub[row]]
        if a.repeated or b.repeated:
            many = [s.times[x] if s.repeated else np.ones(len(x), np.int64) for s, x in ((a, row), (b, other))]
            times = many[0] * many[1]
            done = np.cumsum(times)
            place = np.arange(times.sum()) - np.repeat(done - times, times)
            own, theirs = np.divmod(place, np.repeat(many[1], times))
            row = np.repeat(a.first[row] if a.repeated else row, times) + own
            other = np.repeat(b.first[other] if b.repeated else other, times) + theirs
            pair, logs = np.repeat(pair, times), np.repeat(logs, times)
        shared = np.where(a.masks[row] == b.masks[other], a.mains[row], a.fulls[row] & b.fulls[other])
        bucket = _FIRST[shared]
        score = np.bincount(pair, self.weights[bucket] / logs, n)
        width = len(BUCKETS) + 1
        counts = np.bincount(pair * width + bucket, minlength=n * width).reshape(n, width)
        kept = np.flatnonzero((score >= self.least) & (counts.sum(axis=1) > 0))
        u, v, counts = a.users[p[kept]], b.users[q[kept]], counts[kept].astype(np.int32)
        columns = [np.minimum(u, v), np.maximum(u, v), score[kept], *counts.T[1:]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(x)) for x in columns],
            ["user1", "user2", "score", *COUNT_COLUMNS],
        )

    def pairs(self, a: _Side, b: _Side, hubs: _Hubs) -> Iterator[pa.RecordBatch]:
        """The pairs of two sides, or of one with itself, that could reach the cut."""
        one, two = a.gains(b), b.gains(a)
        found, n_found, n_rows = [], 0, 0
        for r in range(0, len(a.users), TILE):
            for c in range(r if a is b else 0, len(b.users), TILE):
                p, q = self._could(a, r, b, c, one, two, a is b)
                if not len(p):
                    continue
                # As many at a time as have so many memberships.
                part = np.cumsum(a.sizes[p]) // LISTED_AT_ONCE
                for at in np.split(np.arange(len(p)), np.flatnonzero(np.diff(part)) + 1):
                    found.append((p[at], q[at]))
                    n_found += len(at)
                    n_rows += a.sizes[p[at]].sum()
                    if n_found >= SENT_AT_ONCE or n_rows >= LISTED_AT_ONCE:
                        yield self._scores(a, *_joined(found, b), hubs)
                        found, n_found, n_rows = [], 0, 0
            if a is not b:
                a.tiles.clear()
        if n_found:
            yield self._scores(a, *_joined(found, b), hubs)


def _joined(found: list, b: _Side) -> tuple[np.ndarray, _Side, np.ndarray]:
    p, q = (np.concatenate(x) for x in zip(*found, strict=True))
    return p, b, q


def near_pairs(
    hubs: DataFrame, n_rows: int, n_users: int, min_score: float, weight: str = "flat"
) -> DataFrame:
    """(user1, user2, score, n_<bucket>...): what all pairs that reach the cut there share in hubs.

    ``hubs`` has ``n_rows`` rows (mid_id, member_id, mask, degree) of ``n_users`` users, about.
    Some pairs that fall short of the cut by little may be among the result.
    """
    spark = hubs.sparkSession
    ship_package(spark)
    parallel = spark.sparkContext.defaultParallelism
    n_blocks = max(ceil(n_rows / BLOCK_ROWS), min(ceil(sqrt(6 * parallel)), ceil(n_users / TILE)), 1)
    n_pieces = n_blocks * max(1, ceil(n_rows / n_blocks / PIECE_ROWS))
    full = full_buckets("mask")
    rows = hubs.where("mid_id is not null and member_id is not null").selectExpr(
        f"int(pmod(xxhash64(member_id), {n_pieces})) AS piece",
        "mid_id",
        "member_id",
        "degree",
        "coalesce(mask, 0) AS mask",
    )
    kinds = rows.selectExpr(
        "piece",
        f"piece % {n_blocks} AS block",
        "mid_id",
        "member_id",
        "degree",
        "mask",
        f"{first_bucket(main_buckets('mask'))} AS main",
        f"{full} AS full",
        f"sqrt({max_edge_weight(full, weight)}) AS root",
    )
    pieces = kinds.groupBy("piece").applyInArrow(_pack, PACKED)
    # Every piece goes to the cells of its block with all blocks, once to that with itself.
    placed = pieces.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other"))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    n_cells = n_blocks * (n_blocks + 1) // 2
    tasks = min(4 * n_cells, max(n_cells, 2_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Cell(min_score, weight)
        cell, held, of, side = None, [], None, None

        def alone() -> Iterator[pa.RecordBatch]:
            """The pairs of a block with itself, once all of it is there."""
            if cell is not None and cell[0] == cell[1]:
                of = _Hubs.of(held)
                side = _Side(held, of)
                yield from work.pairs(side, side, of)

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if cell != (row["i"], row["j"]):
                    yield from alone()
                    cell, held, of, side = (row["i"], row["j"]), [], None, None
                if row["block"] == row["i"]:
                    held.append(_unpack(row))
                elif held or side is not None:  # a cell with an empty block has one only
                    if side is None:
                        of = _Hubs.of(held)
                        side, held = _Side(held, of), []
                    piece = _unpack(row)
                    if np.isin(piece["mids"], of.mids).any():
                        yield from work.pairs(side, _Side([piece], of), of)
        yield from alone()

    met = placed.drop("other").repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "block")
    return met.mapInArrow(run, FOUND)
