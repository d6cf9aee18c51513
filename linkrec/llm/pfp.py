"""Repeated passages by prefix-free parsing and suffix order.

A passage of ``length`` bytes is a repeat if it also starts in a document with a smaller
key.  Which passages are is worked out on the dictionary of the parse, not on the text:

1. Parse.  Where the rolling hash of the next bytes meets a condition, a phrase starts.
   A phrase is taken with the ``length - 1`` bytes after it, so each passage lies in the
   phrase it starts in.  Equal phrases of all documents meet under a 128-bit hash; a
   phrase that a smaller document has as well is a repeat from end to end.  What is left
   is the dictionary: each distinct phrase once, under its smallest document.
2. Anchors.  In each dictionary passage the smallest rolling hash is its anchor.  Equal
   passages have equal anchors, so a passage whose anchor no other document has is
   unique.  Shortened hashes meet in buckets to find this out, and which anchors have so
   many passages that one task should not hold them.
3. Suffix order.  What is left of the dictionary goes to buckets by anchor, as runs of
   bytes with the same anchor.  A bucket sorts the suffixes that start in its runs by
   their first ``length`` bytes; equal ones stand together, and all but those of the
   smallest document are repeats.  Passages of anchors with very many go one by one to
   buckets by a hash of their own bytes, so that no bucket grows with an anchor.
4. Each document drops the bytes that its repeats cover.

Copies that meet in one task are settled there and only the smallest one is sent on, so
a phrase or passage of any number of copies costs a row per task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrec.llm import packed
from linkrec.llm.common import arrow_map, named, ship_package, total_bytes
from linkrec.storage import fresh_path, stored

LENGTH = 50
ANCHOR = 32  # bytes under the rolling hash; a power of two
PHRASE = 256  # bytes of a phrase on average
BLOCK_BYTES = 1 << 20  # text that a task looks at together
BUCKET_BYTES = 8 << 20
BUCKET_PASSAGES = 300_000
GROUP_BYTES = 32 << 20  # text of the documents whose answers are put together in one task
RUN = 8  # bytes of a run of passages: offset and number
SPLIT_BITS = 22  # leading bits of an anchor that tell whether its passages are split
LAST = (1 << 63) - 1  # stands for a null key: larger than any other
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
WINDOWS = 1 << 16  # passages that are laid out side by side
SORTED = 200_000  # passages that are put in order together
# Odd numbers without any structure, two for each half of a hash.
MULTIPLIERS = (
    (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9),
    (0xD6E8FEB86659FD93, 0x94D049BB133111EB),
)


def rolling(buffer: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on, as far as they reach."""
    h = buffer.astype(np.uint64) + np.uint64(1)
    width, base = 1, 0x9E3779B97F4A7C15
    while width < ANCHOR and len(h) > width:
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % (1 << 64)
    if width < ANCHOR:
        return np.zeros(0, np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of ``size`` values from each place on."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


class Block:
    """Pieces of documents side by side, with hashes over all of them."""

    def __init__(self, pieces: list[tuple[int, int, int, bytes]], length: int):
        self.length = length
        self.k = np.array([p[0] for p in pieces], np.int64)
        self.doc = np.array([p[1] for p in pieces], np.int64)
        self.base = np.array([p[2] for p in pieces], np.int64)
        sizes = np.array([len(p[3]) for p in pieces], np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.raw = b"".join(p[3] for p in pieces)
        self.buffer = np.frombuffer(self.raw, np.uint8)
        self.passages = np.maximum(sizes - length + 1, 0)
        # Where a passage starts that stays inside its piece.
        self.valid = np.zeros(len(self.buffer), bool)
        for a, n in zip(self.start.tolist(), self.passages.tolist(), strict=True):
            self.valid[a : a + n] = True
        self.hash = rolling(self.buffer)

    def piece_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def place(self, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Offset in the document."""
        return at - self.start[piece] + self.base[piece]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of passages of each phrase."""
        cut = np.zeros(len(self.buffer) + 1, bool)
        cut[: len(self.hash)] = self.hash % np.uint64(PHRASE) == 0
        cut[:-1] &= self.valid
        cut[self.start[self.passages > 0]] = True
        starts = np.flatnonzero(cut)
        piece = self.piece_of(starts)
        end = np.append(starts[1:], len(self.buffer))
        return starts, np.minimum(end, self.start[piece] + self.passages[piece]) - starts

    def least(self) -> np.ndarray:
        """The anchor of each passage; of use only where ``valid``."""
        out = np.full(len(self.buffer), NONE)
        low = sliding(self.hash, self.length - ANCHOR + 1, np.minimum)
        out[: len(low)] = low
        return out


def pieces(docs: Iterator[dict], length: int) -> Iterator[tuple[tuple, dict]]:
    """(k, doc, offset, bytes) in pieces that overlap by less than a passage."""
    for d in docs:
        raw = d["text"].encode()
        for at in range(0, max(1, len(raw) - length + 1), BLOCK_BYTES):
            yield (d["k"], d["doc"], at, raw[at : at + BLOCK_BYTES + length - 1]), d


def blocks(docs: Iterator[dict], length: int) -> Iterator[tuple[Block, list[dict]]]:
    held, rows, size = [], [], 0
    for piece, d in pieces(docs, length):
        held.append(piece)
        rows.append(d)
        size += len(piece[3])
        if size >= BLOCK_BYTES:
            yield Block(held, length), rows
            held, rows, size = [], [], 0
    if held:
        yield Block(held, length), rows


def runs_by_key(k: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in order, runs per key, and runs as pairs (offset, number); neighbours are one run."""
    order = np.lexsort((at, k))
    k, at, n = k[order], at[order].astype(np.int64), n[order].astype(np.int64)
    if len(k):
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1] + n[:-1])
        first = np.flatnonzero(new)
        k, at, n = k[first], at[first], np.add.reduceat(n, first)
    starts = packed.group_starts(k)
    sizes = np.diff(np.append(starts, len(k)))
    return k[starts], sizes, np.stack([at, n], 1).astype("<u4").view(np.uint8).reshape(-1, RUN)


def marked(block: Block, rows: list[dict], column: str) -> np.ndarray:
    """Passages of the block that lie in the runs of ``column``."""
    mask = np.zeros(len(block.buffer), bool)
    for i, d in enumerate(rows):
        a, base, n = int(block.start[i]), int(block.base[i]), int(block.passages[i])
        for part in d[column] or ():
            for at, size in np.frombuffer(part, "<u4").reshape(-1, 2).astype(np.int64).tolist():
                lo, hi = max(at - base, 0), min(at - base + size, n)
                if hi > lo:
                    mask[a + lo : a + hi] = True
    return mask


ANSWERS = "part int, ks binary, sizes binary, units binary, large binary, open long"


def _answers(
    k: np.ndarray,
    sizes: np.ndarray,
    units: np.ndarray,
    groups: int,
    large: bytes = b"",
    passages: int = 0,
) -> pa.Table:
    """What a bucket answers, as a row per group of documents.

    Key i gets the next ``sizes[i]`` rows of ``units``.
    """
    group = k.astype(np.int64).view(np.uint64) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    starts, cuts = np.cumsum(sizes) - sizes, packed.group_starts(group[order])
    rows = []
    ends = np.append(cuts[1:], len(k))[: len(cuts)]
    for a, z in zip(cuts, ends, strict=True):
        own = order[a:z]
        rows.append(
            {
                "part": int(group[own[0]]),
                "ks": k[own].astype("<i8").tobytes(),
                "sizes": sizes[own].astype("<u4").tobytes(),
                "units": units[_spread(starts[own], sizes[own])].tobytes(),
            }
        )
    first = {"large": large, "open": passages}
    rows = [r | {"large": b"", "open": 0} for r in rows]
    rows = [rows[0] | first, *rows[1:]] if rows else [{"part": 0} | first]
    names = ["part", "ks", "sizes", "units", "large", "open"]
    kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64()]
    columns = zip(names, kinds, strict=True)
    return pa.table([pa.array([r.get(c) for r in rows], t) for c, t in columns], names)


def _merged(unit: int):
    """One row per document, of all that the buckets answered for a group of documents."""

    def merge(table: pa.Table) -> pa.Table:
        join = lambda c: b"".join(x for x in table.column(c).to_pylist() if x)
        k, sizes = np.frombuffer(join("ks"), "<i8"), np.frombuffer(join("sizes"), "<u4")
        units = np.frombuffer(join("units"), np.uint8).reshape(-1, unit)
        order = np.argsort(k, kind="stable")
        sizes = sizes.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        raw = units[_spread(starts[order], sizes[order])].tobytes()
        first = packed.group_starts(k[order])
        ends = unit * np.cumsum(np.add.reduceat(sizes[order], first)) if len(k) else first
        offsets = pa.array(np.append(0, ends).astype("i4"))
        parts = pa.Array.from_buffers(
            pa.binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(raw)]
        )
        one = pa.array(np.arange(len(first) + 1, dtype="i4"))
        return pa.table(
            [pa.array(k[order][first]), pa.ListArray.from_arrays(one, parts)], ["k", "parts"]
        )

    return merge


def _raw(table: pa.Table, column: str) -> bytes:
    return b"".join(x.as_py() for x in table.column(column))


def _ints(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(_raw(table, column), kind)


# A bucket's questions; without an entry in ``bucket`` a row is an answer already.
ASK = "bucket int, k binary, doc binary, at binary, n binary, h1 binary, h2 binary, body binary"


def _ask(bucket, k, doc, at, n, h1=b"", h2=b"", body=b"") -> dict:
    return {
        "bucket": bucket,
        "k": k.astype("<i8").tobytes(),
        "doc": doc.astype("<i8").tobytes(),
        "at": at.astype("<u4").tobytes(),
        "n": n.astype("<u4").tobytes(),
        "h1": h1,
        "h2": h2,
        "body": body,
    }


def _first_documents(h1, h2, doc) -> tuple[np.ndarray, np.ndarray]:
    """For entries (h1, h2): the smallest document of equal ones, and their sorted order."""
    order = np.lexsort((doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(doc[order][starts], sizes)
    return least, order


def _phrase_questions(buckets: int, length: int):
    cuts = packed.edges(buckets)

    def rows(docs):
        turn = TaskContext.get().partitionId()
        for block, _ in blocks(docs, length):
            start, n = block.phrases()
            if not len(start):
                continue
            ends = (start + n + length - 1).tolist()
            view = memoryview(block.raw)
            digests = b"".join(
                xxhash.xxh3_128_digest(view[a:z])
                for a, z in zip(start.tolist(), ends, strict=True)
            )
            h = np.frombuffer(digests, "<u8").reshape(-1, 2)
            h1, h2, piece = h[:, 0], h[:, 1], block.piece_of(start)
            k, doc, at = block.k[piece], block.doc[piece], block.place(start, piece)
            least, order = _first_documents(h1, h2, doc)
            known = doc > least
            turn += 1
            yield _ask(turn % buckets, k[known], doc[known], at[known], n[known])
            order = order[~known[order]]
            for b, x, z in packed.slices(h1[order], cuts):
                own = order[x:z]
                parts = (packed.to_bytes(h1[own]), packed.to_bytes(h2[own]))
                yield _ask(b, k[own], doc[own], at[own], n[own], *parts)

    return rows


def _phrase_answers(groups: int):
    def answers(table: pa.Table) -> pa.Table:
        raw = zip(table.column("at").to_pylist(), table.column("h1").to_pylist(), strict=True)
        asked = np.concatenate([np.full(len(x) // 4, bool(h)) for x, h in raw])
        k, doc = _ints(table, "k", "<i8"), _ints(table, "doc", "<i8")
        at, n = _ints(table, "at", "<u4"), _ints(table, "n", "<u4")
        repeat = ~asked
        h1, h2 = _ints(table, "h1", "<u8"), _ints(table, "h2", "<u8")
        least, _ = _first_documents(h1, h2, doc[asked])
        repeat[asked] = doc[asked] > least
        return _answers(*runs_by_key(k[repeat], at[repeat], n[repeat]), groups)

    return answers


def _anchor_questions(buckets: int, width: int, length: int):
    cuts = packed.edges(buckets, width)

    def rows(docs):
        turn = TaskContext.get().partitionId()
        for block, given in blocks(docs, length):
            own = block.valid & ~marked(block, given, "repeats")
            if not own.any():
                continue
            least = block.least()
            at = np.flatnonzero(own)
            piece = block.piece_of(at)
            # Each anchor of a document once.
            value = least[at]
            change = np.ones(len(at), bool)
            change[1:] = (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])
            n = np.diff(np.append(np.flatnonzero(change), len(at)))
            k, short = block.k[piece[change]], packed.shorten(value[change], width)
            order = np.lexsort((k, short))
            k, short = k[order], short[order]
            new = np.ones(len(k), bool)
            new[1:] = (short[1:] != short[:-1]) | (k[1:] != k[:-1])
            n = np.add.reduceat(n[order], np.flatnonzero(new))
            k, short = k[new], short[new]
            starts = packed.group_starts(short)
            sizes = np.diff(np.append(starts, len(short)))
            total = np.add.reduceat(n, starts)
            several = np.repeat(sizes > 1, sizes)
            turn += 1
            yield by_key(turn % buckets, k[several], short[several], n[several], b"known")
            first = short[starts[sizes > 1]]  # tells others of the anchor, asks nothing
            total = total[sizes > 1]
            for b, x, z in packed.slices(first, cuts):
                yield by_key(b, k[:0], first[x:z], total[x:z], b"asked")
            k, short, n = k[~several], short[~several], n[~several]
            for b, x, z in packed.slices(short, cuts):
                yield by_key(b, k[x:z], short[x:z], n[x:z], b"asked")

    def by_key(bucket, k, short, passages, body):
        """A question with each document named once, before its hashes.

        ``at`` has the passages of each hash in this block, as a power of two from above.
        """
        if len(k):
            order = np.argsort(k, kind="stable")
            k, short, passages = k[order], short[order], passages[order]
        starts = packed.group_starts(k)
        return {
            "bucket": bucket,
            "k": k[starts].astype("<i8").tobytes(),
            "at": np.ceil(np.log2(passages)).astype(np.uint8).tobytes(),
            "n": np.diff(np.append(starts, len(k))).astype("<u4").tobytes(),
            "h1": packed.to_bytes(short, width),
            "body": body,
        }

    return rows


def _anchor_answers(width: int, most: int, groups: int):
    """Shared anchors of each document; ``large`` has those with over ``most`` passages.

    ``open`` is about how many passages have a shared anchor; those of large ones, which
    travel one by one, count four times.
    """

    def answers(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("k", "n", "h1", "body")]
        asks = [body == b"asked" for body in columns[3]]
        hashes = packed.from_bytes(
            b"".join(h for h, a in zip(columns[2], asks, strict=True) if a), width
        )
        powers = b"".join(
            p for p, a in zip(table.column("at").to_pylist(), asks, strict=True) if a
        )
        order = np.argsort(hashes, kind="stable")
        starts = packed.group_starts(hashes[order])
        sizes = np.diff(np.append(starts, len(order)))
        shared = np.empty(len(order), bool)
        shared[order] = np.repeat(sizes > 1, sizes)
        large, open_ = b"", 0
        if len(order):
            passages = np.int64(1) << np.frombuffer(powers, np.uint8)[order].astype(np.int64)
            each = np.add.reduceat(passages, starts)
            over = each > most
            large = np.unique(_split_place(hashes[order][starts[over]], width)).tobytes()
            # Anchors that several documents of a block have are asked for with their sum.
            open_ = int(each[(sizes > 1) & ~over].sum() + 4 * each[over].sum())
        known = [p for p, a in zip(table.column("at").to_pylist(), asks, strict=True) if not a]
        alone = (np.int64(1) << np.frombuffer(b"".join(known), np.uint8).astype(np.int64)).sum()
        keys, told, done = [], [], 0
        for k, n, raw, body in zip(*columns, strict=True):
            keys.append(np.repeat(np.frombuffer(k, "<i8"), np.frombuffer(n, "<u4")))
            if body == b"asked":
                size = len(keys[-1]) if len(k) else len(raw) // width
                told.append(shared[done : done + size] if len(k) else np.zeros(0, bool))
                done += size
            else:
                told.append(np.ones(len(keys[-1]), bool))
        own = [raw for k, raw in zip(columns[0], columns[2], strict=True) if len(k)]
        told, keys = np.concatenate(told), np.concatenate(keys)
        units = np.frombuffer(b"".join(own), np.uint8).reshape(-1, width)[told]
        keys = keys[told]
        order = np.argsort(keys, kind="stable")
        starts = packed.group_starts(keys[order])
        sizes = np.diff(np.append(starts, len(keys)))
        passages = max(open_, int(alone))
        return _answers(keys[order][starts], sizes, units[order], groups, large, passages)

    return answers


def _split_place(short: np.ndarray, width: int) -> np.ndarray:
    """Leading bits of shortened anchors."""
    bits = 8 * width
    if bits > SPLIT_BITS:
        short = short >> np.uint64(bits - SPLIT_BITS)
    return short.astype("<u4")


def _split_places(told: DataFrame) -> bytes:
    """A bit for each value of an anchor's leading bits: whether its passages are split.

    Its size is fixed.  That anchors share a bit is no harm: all tasks see the same bits.
    """
    split = np.zeros(1 << SPLIT_BITS, bool)
    for r in told.where(F.octet_length("large") > 0).select("large").toLocalIterator():
        split[np.frombuffer(r["large"], "<u4")] = True
    return np.packbits(split).tobytes()


def _passage_questions(buckets: int, width: int, length: int, places: bytes):
    cuts = packed.edges(buckets)
    longest = 4096  # of a run, for texts that repeat one anchor

    def rows(docs):
        turn = TaskContext.get().partitionId()
        split = np.unpackbits(np.frombuffer(places, np.uint8)).astype(bool)
        for block, given in blocks(docs, length):
            least = block.least()
            own = block.valid & ~marked(block, given, "repeats")
            open_ = np.zeros(len(own), bool)
            short = packed.shorten(least, width)
            for i, d in enumerate(given):
                a, n = int(block.start[i]), int(block.passages[i])
                values = np.concatenate([packed.from_bytes(p, width) for p in d["anchors"]])
                open_[a : a + n] = np.isin(short[a : a + n], values)
            at = np.flatnonzero(own & open_)
            if not len(at):
                continue
            piece, value = block.piece_of(at), least[at]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])
            run_at = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            new |= (np.arange(len(at)) - run_at) % longest == 0
            alone = split[_split_place(short[at], width)]
            new |= alone
            starts = np.flatnonzero(new)
            n = np.diff(np.append(starts, len(at)))
            at, piece, value, alone = at[starts], piece[starts], value[starts], alone[starts]
            h = np.empty((len(at), 2), np.uint64)
            h[alone] = window_hashes(block.buffer, at[alone], length)
            view, runs = memoryview(block.raw), ~alone
            ends = (at[runs] + n[runs] + length - 1).tolist()
            h[runs] = np.frombuffer(
                b"".join(
                    xxhash.xxh3_128_digest(view[a:z])
                    for a, z in zip(at[runs].tolist(), ends, strict=True)
                ),
                "<u8",
            ).reshape(-1, 2)
            k, doc, place = block.k[piece], block.doc[piece], block.place(at, piece)
            first, _ = _first_documents(h[:, 0], h[:, 1], doc)
            known = doc > first
            turn += 1
            yield _ask(turn % buckets, k[known], doc[known], place[known], n[known])
            value = np.where(alone, h[:, 0], value)
            order = np.argsort(value, kind="stable")
            order = order[~known[order]]
            for b, x, z in packed.slices(value[order], cuts):
                ask = order[x:z]
                body = block.buffer[_spread(at[ask], n[ask] + length - 1)].tobytes()
                yield _ask(b, k[ask], doc[ask], place[ask], n[ask], b"asked", b"", body)

    return rows


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] places, one i after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def window_hashes(buffer: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """128 bits of each passage of ``length`` bytes that starts ``at``, as two columns."""
    width = -(-length // 8) * 8
    windows = np.lib.stride_tricks.sliding_window_view(buffer, length)
    out = np.empty((len(at), 2), np.uint64)
    for a in range(0, len(at), WINDOWS):
        part = at[a : a + WINDOWS]
        rows = np.zeros((len(part), width), np.uint8)
        rows[:, :length] = windows[part]
        words = rows.view("<u8")
        for side, (one, two) in enumerate(MULTIPLIERS):
            h = np.full(len(part), one, np.uint64)
            for j in range(width // 8):
                h = (h ^ words[:, j]) * np.uint64(one)
                h ^= h >> np.uint64(32)
                h *= np.uint64(two)
                h ^= h >> np.uint64(29)
            out[a : a + WINDOWS, side] = h
    return out


def suffix_order(body: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes starting ``at`` in the order of their first bytes, and where new ones begin."""
    width = -(-length // 8) * 8
    rows = np.zeros((len(at), width), np.uint8)
    rows[:, :length] = np.lib.stride_tricks.sliding_window_view(body, length)[at]
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    ordered = words[order]
    new = np.ones(len(at), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


def _passage_answers(length: int, groups: int):
    def answers(table: pa.Table) -> pa.Table:
        asked = np.concatenate(
            [
                np.full(len(x) // 4, bool(h))
                for x, h in zip(*(table.column(c).to_pylist() for c in ("at", "h1")), strict=True)
            ]
        )
        k, doc = _ints(table, "k", "<i8"), _ints(table, "doc", "<i8")
        at = _ints(table, "at", "<u4").astype(np.int64)
        n = _ints(table, "n", "<u4").astype(np.int64)
        parts = [(k[~asked], at[~asked], n[~asked])]
        k, doc, at, n = k[asked], doc[asked], at[asked], n[asked]
        if len(k):
            body = np.frombuffer(_raw(table, "body"), np.uint8)
            size = n + length - 1
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            suffix = np.repeat(np.cumsum(size) - size, n) + inside
            whose = np.repeat(doc, n)
            repeat = np.zeros(len(suffix), bool)
            # Equal passages have equal hashes, so a large bucket is put in order in parts.
            turns = -(-len(suffix) // SORTED)
            turn = np.zeros(len(suffix), np.uint64)
            if turns > 1:
                turn = window_hashes(body, suffix, length)[:, 0] % np.uint64(turns)
            for t in range(turns):
                own = np.flatnonzero(turn == np.uint64(t))
                if not len(own):
                    continue
                order, starts = suffix_order(body, suffix[own], length)
                order = own[order]
                least = np.minimum.reduceat(whose[order], starts)
                sizes = np.diff(np.append(starts, len(order)))
                repeat[order] = whose[order] > np.repeat(least, sizes)
            keys, places = np.repeat(k, n)[repeat], (np.repeat(at, n) + inside)[repeat]
            parts.append((keys, places, np.ones(len(keys), np.int64)))
        k, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _answers(*runs_by_key(k, at, n), groups)

    return answers


def _told(questions: DataFrame, answers, name: str) -> DataFrame:
    """What each bucket answers."""
    return stored(questions.groupBy("bucket").applyInArrow(answers, ANSWERS), name)


def _by_document(told: DataFrame, unit: int) -> DataFrame:
    """(k, parts): what the buckets answered for each document."""
    rows = told.where("ks is not null").select("part", "ks", "sizes", "units")
    return rows.groupBy("part").applyInArrow(_merged(unit), "k long, parts array<binary>")


def dealt_table(given: DataFrame, buckets: int) -> DataFrame:
    """``given`` as a table bucketed by ``k``, so that joins on it move no text."""
    spark = given.sparkSession
    name, path = f"linkrec_{uuid.uuid4().hex}", fresh_path(spark, "texts")
    writer = given.repartition(buckets, "k").write.bucketBy(buckets, "k").option("path", path)
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def drop_repeats(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_passages: int = BUCKET_PASSAGES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, removed), a row per row of ``df``.

    Texts are UTF-8 bytes.  A byte goes if a string of ``length`` bytes that covers it in
    this document also starts in one with a smaller key; strings are judged on the input.
    ``kept`` is binary, as cuts may fall inside characters; ``removed`` has the maximal
    removed runs as pairs (offset, length).  Keys are integers; a null key counts as larger
    than all others.  Null texts count as empty.  Rows of equal keys do not remove from
    each other.  Texts of any length are worked on in overlapping pieces.
    """
    if length < ANCHOR:
        raise ValueError(f"a passage has at least {ANCHOR} bytes")
    spark = df.sparkSession
    ship_package(spark)
    key, body = named(doc_id).cast("long"), F.coalesce(named(text), F.lit(""))
    given = df.select(
        key.alias("doc_id"),
        F.coalesce(key, F.lit(LAST)).alias("doc"),
        F.xxhash64(key, body).alias("k"),
        body.alias("text"),
    )
    size = total_bytes(given)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = dealt_table(given, max(least, -(-size // (16 << 20))))
    width = packed.filter_width(size // 8)
    groups = max(1, -(-size // GROUP_BYTES))
    phrase_buckets = packed.n_buckets(size / PHRASE * 40, bucket_bytes)
    asked = arrow_map(
        table.select("k", "doc", "text"), _phrase_questions(phrase_buckets, length), ASK, 64
    )
    told = _told(asked, _phrase_answers(groups), "phrases")
    repeats = _by_document(told, RUN).withColumnRenamed("parts", "repeats")
    repeats = stored(repeats, "repeats")

    own = table.select("k", "doc", "text").join(repeats.hint("shuffle_hash"), "k", "left")
    anchor_buckets = packed.n_buckets(size / 8 * width, bucket_bytes)
    asked = arrow_map(own, _anchor_questions(anchor_buckets, width, length), ASK, 64)
    told = _told(asked, _anchor_answers(width, max(1, bucket_passages // 4), groups), "anchors")
    anchors = stored(_by_document(told, width).withColumnRenamed("parts", "anchors"), "anchors_of")
    places = _split_places(told)

    some = own.join(anchors.hint("shuffle_hash"), "k")
    n_open = told.agg(F.coalesce(F.sum("open"), F.lit(0))).first()[0]
    passage_buckets = max(1, -(-n_open // bucket_passages))
    questions = _passage_questions(passage_buckets, width, length, places)
    told = _told(arrow_map(some, questions, ASK, 64), _passage_answers(length, groups), "passages")
    passages = _by_document(told, RUN).withColumnRenamed("parts", "passages")

    def cut(docs):
        for d in docs:
            raw = d["text"].encode()
            parts = [*(d["repeats"] or ()), *(d["passages"] or ())]
            spans = covered(parts, length)
            kept, at = [], 0
            for a, n in spans:
                kept.append(raw[at:a])
                at = a + n
            kept = b"".join([*kept, raw[at:]])
            yield {
                "doc_id": d["doc_id"],
                "n_bytes": len(raw),
                "n_removed": len(raw) - len(kept),
                "n_spans": len(spans),
                "kept": kept,
                "removed": [{"at": a, "n": n} for a, n in spans],
            }

    final = (
        table.select("doc_id", "k", "text")
        .join(repeats.hint("shuffle_hash"), "k", "left")
        .join(stored(passages, "passages_of").hint("shuffle_hash"), "k", "left")
    )
    return arrow_map(
        final.drop("k"),
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
        "removed array<struct<at: long, n: long>>",
        256,
    )


def covered(parts: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the passages in packed runs cover."""
    if not parts:
        return []
    runs = np.frombuffer(b"".join(parts), "<u4").reshape(-1, 2).astype(np.int64)
    start, end = runs[:, 0], runs[:, 0] + runs[:, 1] + length - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return list(zip(start[first].tolist(), (end[last] - start[first]).tolist(), strict=True))

