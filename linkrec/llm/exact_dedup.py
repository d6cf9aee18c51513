"""Exact duplicates by composable polynomial fingerprints.

A text without its white space is a byte sequence b; its fingerprint is the pair of
sum(b[i] * B ** (n - 1 - i)) mod p for two primes p, beside its length n.  The
fingerprint of joined parts is that of the first, shifted by the length of the
second, plus that of the second, so the chunks of a huge document are hashed in
parallel tasks and summed.  Rows of equal fingerprint are then compared chunk by
chunk: a chunk's bytes are grouped under (fingerprint, place), where copies meet as
one row per task, so a group of any size costs one copy per task.  Where a place has
more than one content, the fingerprint is split by content.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrec.llm.common import arrow_map, texts
from linkrec.storage import stored

SPACE = b" \t\n\x0b\x0c\r"
# Two primes below 2**31, and a base for each.
PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_013))
# Bytes hashed by one product; sums of 2**16 terms below 2**39 stay below 2**63.
CHUNK = 1 << 16
# Texts above this many bytes are hashed by several tasks.
HUGE = 16 << 20


class Powers:
    """Descending powers of each base, for chunks of up to CHUNK bytes."""

    def __init__(self, primes=PRIMES):
        self.primes = primes
        self.tables = []
        for p, base in primes:
            table = np.ones(CHUNK, np.int64)
            for k in range(1, CHUNK):
                table[k] = table[k - 1] * base % p
            self.tables.append(table[::-1].copy())

    def chunk(self, data: np.ndarray) -> list[int]:
        wide = data.astype(np.int64)
        return [
            int(np.dot(wide, t[CHUNK - len(wide) :]) % p)
            for t, (p, _) in zip(self.tables, self.primes, strict=True)
        ]

    def joined(self, first: list[int], second: list[int], n: int) -> list[int]:
        """The fingerprint of two parts, the second of ``n`` bytes."""
        return [
            (a * pow(base, n, p) + b) % p
            for a, b, (p, base) in zip(first, second, self.primes, strict=True)
        ]

    def whole(self, raw: bytes) -> list[int]:
        data, out = np.frombuffer(raw, np.uint8), [0] * len(self.primes)
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            out = self.joined(out, self.chunk(part), len(part))
        return out


_POWERS: dict[tuple, Powers] = {}


def powers(primes: tuple) -> Powers:
    if primes not in _POWERS:
        _POWERS[primes] = Powers(primes)
    return _POWERS[primes]


def normalised(text: str) -> bytes:
    return text.encode().translate(None, SPACE)


def fingerprints(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    primes: tuple = PRIMES,
    huge: int = HUGE,
) -> DataFrame:
    """(doc_id, row_hash, n_chars, n_bytes, f1, f2, text_sha256), a row per row of ``df``.

    ``row_hash`` stands for key and text together.
    """
    given = texts(df, doc_id, text).select(
        "doc_id",
        "text",
        F.xxhash64("doc_id", "text").alias("row_hash"),
        F.char_length("text").cast("long").alias("n_chars"),
    )
    kind = given.schema[0].dataType.simpleString()

    def rows(docs):
        own = powers(primes)
        for d in docs:
            raw = normalised(d.pop("text"))
            f1, f2 = own.whole(raw) if len(raw) <= huge else (-1, -1)
            sha = hashlib.sha256(raw).hexdigest()
            yield d | {"n_bytes": len(raw), "f1": f1, "f2": f2, "text_sha256": sha}

    schema = (
        f"doc_id {kind}, row_hash long, n_chars long, n_bytes long, f1 long, f2 long, "
        "text_sha256 string"
    )
    done = stored(
        arrow_map(given, rows, schema, 512).withColumn("row_no", F.monotonically_increasing_id()),
        "fingerprints",
    )
    late = done.where("f1 < 0")
    if not late.limit(1).count():
        return done
    big = huge_fingerprints(given.where(F.octet_length("text") > huge), primes)
    late = late.drop("f1", "f2").join(big, ["row_hash", "n_bytes"])
    return done.where("f1 >= 0").unionByName(late.select(done.columns))


def huge_fingerprints(given: DataFrame, primes: tuple = PRIMES) -> DataFrame:
    """(row_hash, n_bytes, f1, f2) of texts whose chunks are hashed in parallel."""
    step = CHUNK * 16

    def cut(docs):
        for d in docs:
            raw = normalised(d["text"])
            for at in range(0, len(raw), step):
                yield {
                    "row_hash": d["row_hash"],
                    "n_bytes": len(raw),
                    "after": max(0, len(raw) - at - step),
                    "part": raw[at : at + step],
                }

    def hashed(parts):
        own, none = powers(primes), [0] * len(primes)
        for d in parts:
            f1, f2 = own.joined(own.whole(d["part"]), none, d["after"])  # shifted by what follows
            yield {"row_hash": d["row_hash"], "n_bytes": d["n_bytes"], "f1": f1, "f2": f2}

    one = given.select("row_hash", "text").dropDuplicates()
    parts = arrow_map(one, cut, "row_hash long, n_bytes long, after long, part binary", 16)
    spread = parts.repartition("row_hash", "after")
    sums = arrow_map(spread, hashed, "row_hash long, n_bytes long, f1 long, f2 long", 16)
    return sums.groupBy("row_hash", "n_bytes").agg(
        (F.sum("f1") % primes[0][0]).alias("f1"), (F.sum("f2") % primes[1][0]).alias("f2")
    )


PRINT = ["n_bytes", "f1", "f2"]


def _chunks(df: DataFrame, doc_id: str, text: str, primes: tuple) -> DataFrame:
    """(n_bytes, f1, f2, place, part, row_hash): normalised bytes of every row, in chunks."""

    def rows(docs):
        own = powers(primes)
        for d in docs:
            raw = normalised(d["text"])
            f1, f2 = own.whole(raw)
            for place, at in enumerate(range(0, len(raw), CHUNK)):
                yield {
                    "n_bytes": len(raw),
                    "f1": f1,
                    "f2": f2,
                    "place": place,
                    "part": raw[at : at + CHUNK],
                    "row_hash": d["row_hash"],
                }

    given = texts(df, doc_id, text).select("text", F.xxhash64("doc_id", "text").alias("row_hash"))
    schema = "n_bytes long, f1 long, f2 long, place int, part binary, row_hash long"
    return arrow_map(given, rows, schema, 512)


def mixed_prints(chunks: DataFrame) -> DataFrame:
    """Fingerprints under which some place has more than one content."""
    contents = chunks.groupBy(*PRINT, "place", "part").agg(F.count("*").alias("n"))
    places = contents.groupBy(*PRINT, "place").agg(F.count("*").alias("n_contents"))
    return places.where("n_contents > 1").select(*PRINT).distinct()


def split_by_content(chunks: DataFrame, mixed: DataFrame) -> DataFrame:
    """(n_bytes, f1, f2, row_hash, variant): rows of mixed fingerprints, told apart by content."""
    own = chunks.join(mixed, PRINT, "left_semi").distinct()
    named = own.groupBy(*PRINT, "place", "part").agg(F.min("row_hash").alias("first"))
    each = own.join(named, [*PRINT, "place", "part"])
    listed = F.sort_array(F.collect_list(F.struct("place", "first")))
    return each.groupBy(*PRINT, "row_hash").agg(
        F.sha2(F.to_json(listed), 256).alias("variant")
    )


def exact_groups(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    primes: tuple = PRIMES,
    huge: int = HUGE,
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, row_hash.

    Texts are equal when they are so after white space is deleted; of equal ones the
    longest original stays, then the smallest key.  Null texts count as empty, all empty
    ones are equal.  Null keys lose ties.  Of rows that repeat both key and text exactly
    one is kept.  An empty table gives an empty result.
    """
    done = fingerprints(df, doc_id, text, primes, huge)
    chunks = _chunks(df, doc_id, text, primes)
    mixed = stored(mixed_prints(chunks), "mixed")
    if mixed.limit(1).count():
        variants = split_by_content(chunks, mixed)
        done = done.join(variants, [*PRINT, "row_hash"], "left")
        done = stored(done.fillna("", ["variant"]), "fingerprints")
    else:
        done = done.withColumn("variant", F.lit(""))
    best = F.min(
        F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull(), "doc_id", "row_no")
    )
    groups = stored(
        done.groupBy(*PRINT, "variant").agg(F.count("*").alias("group_size"), best.alias("best")),
        "groups",
    )
    return done.join(groups, [*PRINT, "variant"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        "text_sha256",
        "row_hash",
    )
