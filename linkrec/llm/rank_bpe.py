"""Byte-level BPE by the ranks of a vocabulary file, many pieces at a time.

A pattern cuts texts into pieces.  Pieces that are no token themselves are laid out, by
length, in padded numpy matrices of ids.  In each round every row merges its leftmost pair
of the smallest rank, looked up in a hash table of pairs; rows without such a pair leave
the matrix.  A row loses one column a round, so all stay aligned.

A row of very many bytes would need as many rounds.  It is worked on alone, and a round
merges all places of its smallest pair from the left, as far as no merge makes a pair of
a smaller rank, which has the same result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linkrec.llm.common import named, ship_package, texts

NEVER = np.int32(0x7FFFFFFF)
LONG = 256  # bytes from which on a piece is merged alone
REMEMBERED = 300_000  # pieces known per worker; the older half goes when there are as many
TEXT = 1 << 20  # characters that are worked on together
PIECES = 1 << 17  # pieces of one long text at a time
MATRIX = 1 << 22  # entries of a matrix


class PairTable:
    """Ranks of the tokens that pairs of tokens make, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (2 * max(1, len(pairs))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NEVER, np.int32)
        at = np.array(list(pairs), np.int64).reshape(-1, 2)
        keys, ranks = at[:, 0] << 32 | at[:, 1], np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys, one gets the slot
            placed = self.keys[slot] == keys
            self.ranks[slot[placed]] = ranks[placed]
            keys, ranks, slot = keys[~placed], ranks[~placed], slot[~placed] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NEVER where it makes no token."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NEVER)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


class Ranks:
    """A vocabulary of byte strings with ranks, which are their ids."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs = PairTable(pairs)
        self.of_byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError(f"{path} has no rank for some byte")
        size = max(self.rank.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, rank in self.rank.items():
            self.length[rank] = len(token)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.zeros(int(self.length.sum()), np.uint8)
        for token, rank in self.rank.items():
            at = self.start[rank]
            self.bytes[at : at + len(token)] = np.frombuffer(token, np.uint8)
        self.pattern = regex.compile(pattern)
        self.remembered = remembered
        self._forget()

    # -- pieces that are known already

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1, np.int64)  # where each known piece's ids start, and the end

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        if len(self.known) + len(pieces) > self.remembered and self.known:
            self._forget_half()
        sizes, ids = self.merge([p.encode() for p in pieces])
        end = int(self.first[-1])
        if end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:end], np.empty(end + 2 * len(ids), np.int32)])
        self.ids[end : end + len(ids)] = ids
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.first = np.concatenate([self.first, end + np.cumsum(sizes)])

    def _forget_half(self) -> None:
        """The later half of the known pieces stays."""
        at = len(self.known) // 2
        kept, begin, end = list(self.known)[at:], int(self.first[at]), int(self.first[-1])
        self.known = dict(zip(kept, range(len(kept)), strict=True))
        self.ids = self.ids[begin:end].copy()
        self.first = self.first[at:] - begin

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all their ids one after the other."""
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            before = len(known)
            self._learn(new)
            if self.known is not known or len(self.known) < before:
                known = self.known
                again = [p for p in dict.fromkeys(pieces) if p not in known]
                if again:  # some were in the half that went
                    self._add(again)
        at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.first[at + 1] - self.first[at]
        return sizes, self.ids[spread(self.first[at], sizes)]

    def _add(self, pieces: list[str]) -> None:
        limit, self.remembered = self.remembered, NEVER
        try:
            self._learn(pieces)
        finally:
            self.remembered = limit

    # -- merging

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece: how many, and all of them one after the other."""
        sizes = np.ones(len(pieces), np.int64)
        whole = np.fromiter((self.rank.get(p, -1) for p in pieces), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (pieces, matrix of their ids)
        todo = np.flatnonzero((whole < 0) & (lengths > 0))
        sizes[lengths == 0] = 0
        order = todo[np.argsort(lengths[todo], kind="stable")]
        at = 0
        while at < len(order):
            low = int(lengths[order[at]])
            if low >= LONG:
                ids = self._alone(np.frombuffer(pieces[order[at]], np.uint8))
                parts.append((order[at : at + 1], ids[None]))
                sizes[order[at]] = len(ids)
                at += 1
                continue
            width = low + low // 4  # rows of about one length are padded to it
            end = int(np.searchsorted(lengths[order], width, "right"))
            end = min(end, at + max(1, MATRIX // width))
            rows = order[at:end]
            for done, ids in self._together([pieces[i] for i in rows.tolist()], lengths[rows]):
                parts.append((rows[done], ids))
                sizes[rows[done]] = (ids >= 0).sum(axis=1)
            at = end
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        out[start[whole >= 0]] = whole[whole >= 0]
        for which, ids in parts:
            has = ids >= 0
            inside = np.cumsum(has, axis=1) - 1
            out[(start[which][:, None] + inside)[has]] = ids[has]
        return sizes, out

    def _together(
        self, pieces: list[bytes], lengths: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids padded with -1) as rows are found to have no more merge."""
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.of_byte[raw.reshape(len(pieces), width)]
        ids[np.arange(width) >= lengths[:, None]] = -1
        rows = np.arange(len(pieces))
        ranks = np.full((len(pieces), width - 1), NEVER, np.int32)
        pair = ids[:, 1:] >= 0
        ranks[pair] = self.pairs.find(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(rows):
            if not ranks.shape[1]:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NEVER
            if done.any():
                yield rows[done], ids[done]
                go = ~done
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    return
            n, width = ids.shape
            each = np.arange(n)
            ids[each, at] = best
            ids = ids[np.arange(width) != at[:, None] + 1].reshape(n, width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < width - 2)
            after = ids[right, at[right] + 1]
            found = self.pairs.find(best[right], np.maximum(after, 0))
            ranks[right, at[right]] = np.where(after >= 0, found, NEVER)

    def _alone(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one long piece."""
        find = self.pairs.find
        ids = self.of_byte[raw]
        ranks = find(ids[:-1], ids[1:])
        while len(ranks):
            low = ranks.min()
            if low == NEVER:
                break
            at = np.flatnonzero(ranks == low)
            # Of overlapping places every second one, from the left.
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            inside = np.arange(len(at)) - np.maximum.accumulate(
                np.where(new, np.arange(len(at)), 0)
            )
            at = at[inside % 2 == 0]
            # What a merge has to its left has been merged by then, to its right not yet.
            joined = np.zeros(len(ids), bool)
            joined[at + 1] = True
            to_left = np.where(joined[at - 1], low, ids[at - 1])
            lower = find(to_left, np.full(len(at), low)) < low
            lower[0] &= at[0] > 0
            follows = at + 2 < len(ids)
            lower[follows] |= find(np.full(int(follows.sum()), low), ids[at[follows] + 2]) < low
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = low
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            place = at - np.arange(len(at))
            before, after = place[place > 0] - 1, place[place < len(ids) - 1]
            ranks[before] = find(ids[before], ids[before + 1])
            ranks[after] = find(ids[after], ids[after + 1])
        return ids

    # -- texts

    def encode(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all their ids one after the other."""
        if len(given) == 1 and len(given[0]) > TEXT:
            found = (m[0] for m in self.pattern.finditer(given[0]))
            parts = []
            while some := list(islice(found, PIECES)):
                parts.append(self.of_pieces(some)[1])
            ids = np.concatenate(parts)
            return np.array([len(ids)]), ids
        pieces: list[str] = []
        ends = [0]
        for text in given:
            pieces += self.pattern.findall(text)
            ends.append(len(pieces))
        sizes, ids = self.of_pieces(pieces)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(sums[ends]), ids

    def decode(self, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes each of the texts has, and all their bytes; unknown ids have none."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.length))
        ids = np.where(known, ids, 0)
        lengths = np.where(known, self.length[ids], 0)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(sums[ends]), self.bytes[spread(self.start[ids], lengths)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] places, one i after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@cache
def ranks(path: str, pattern: str) -> Ranks:
    """The vocabulary of a file, built once per worker process."""
    return Ranks(path, pattern)


def together(given: list[str]) -> Iterator[list[str]]:
    """Texts in groups of bounded size; a longer text is a group of its own."""
    held, size = [], 0
    for text in given:
        if held and size + len(text) > TEXT:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"))


def _binaries(sizes: np.ndarray, raw: np.ndarray) -> pa.Array:
    offsets = _offsets(sizes)
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(raw.tobytes())]
    )


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """(doc_id, token_ids): ids of every whole text, as array<int>, without special tokens.

    ``path`` names a file of base64 tokens and ranks, ``pattern`` cuts texts; each match is
    encoded by itself, and what no match covers is left out.  With ``decoded`` a column
    ``decoded`` has the bytes that the ids stand for.  A null or empty text has no ids.
    Repeated rows and null keys give a row each; an empty table gives an empty one.  Texts
    of any length are encoded whole, part by part.
    """
    ship_package(df.sparkSession)
    given = texts(df, doc_id, text)
    kind = given.schema[0].dataType
    fields = [("doc_id", to_arrow_type(kind)), ("token_ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields + [("decoded", pa.binary())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks(path, pattern)
        for b in batches:
            at = 0
            for group in together(b.column(1).to_pylist()):
                sizes, ids = own.encode(group)
                lists = pa.ListArray.from_arrays(_offsets(sizes), pa.array(ids))
                columns = [b.column(0).slice(at, len(group)), lists]
                if decoded:
                    columns.append(_binaries(*own.decode(sizes, ids)))
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        pa.default_memory_pool().release_unused()  # the worker lives on

    out = f"doc_id {kind.simpleString()}, token_ids array<int>" + ", decoded binary" * decoded
    return given.mapInArrow(run, out)


def decode(
    df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "token_ids"
) -> DataFrame:
    """(doc_id, token_ids, decoded): the bytes of every list of ids.

    Null lists count as empty; null and unknown ids stand for no bytes.
    """
    ship_package(df.sparkSession)
    none = F.array().cast("array<int>")
    lists = F.transform(named(ids).cast("array<int>"), lambda x: F.coalesce(x, F.lit(-1)))
    given = df.select(named(doc_id).alias("doc_id"), F.coalesce(lists, none).alias("token_ids"))
    kind = given.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks(path, pattern)
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            raw = own.decode(sizes, lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists, _binaries(*raw)], names=["doc_id", "token_ids", "decoded"]
            )

    out = f"doc_id {kind.simpleString()}, token_ids array<int>, decoded binary"
    return given.mapInArrow(run, out)
