"""Importance resampling towards a target corpus, with an exact distributed selection.

1. Features of a text are its words and pairs of neighbouring words, hashed into buckets.
   Both corpora are counted by bucket; a table of the buckets' log ratios scores a text
   by array look-ups, and noise from a hash of the key turns the best scores into a draw.
2. The cutoff is found by weighted median of medians.  A task takes the medians of its
   batches, weighted by their sizes, to one median; the driver takes the weighted median
   of those as pivot and counts what is not above it.  At least an eighth of what remains
   lies on either side, so a fraction goes each time, until the exact cutoff key is known.
3. Only the winners are sorted, in ranges, and numbered from the sizes of the ranges.

Keys (score, doc_id, row number) are all different, so the cutoff is one row, whatever ties.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrec.llm.common import arrow_map, named, ship_package
from linkrec.storage import stored

BUCKETS = 10_000
CHUNK = 1 << 20  # bytes of a text that are held as words
# The driver looks at no more keys than this when it names the last one.
FEW = 2_000
LAST = (1 << 63) - 1  # stands for a null key: after all others
# A-Z in lower case; bytes that are no part of a word become spaces.
WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def feature_buckets(text: str, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) of ``text``, part by part."""
    raw = text.encode().translate(WORD)
    at, before = 0, None
    while at < len(raw):
        end = at + CHUNK
        end = len(raw) if end >= len(raw) else raw.find(b" ", end) + 1 or len(raw)
        words = raw[at:end].split()
        at = end
        if not words:
            continue
        single = list(map(crc32, words))
        # A crc goes on where another one ended, so no pair is ever joined.
        spaced = map(crc32, repeat(b" "), single)
        if before is None:
            pairs = map(crc32, words[1:], spaced)
        else:
            pairs = map(crc32, words, chain([before], spaced))
        both = np.fromiter(chain(single, pairs), np.int64)
        before = crc32(b" ", single[-1])
        yield len(words), both % buckets


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the features of all texts; a task sends each bucket once."""
    ship_package(df.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                for _, found in feature_buckets(t.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.record_batch([pa.array(has.astype("i4")), pa.array(total[has])], schema=schema)

    rows = df.select(named(text).alias("text")).where("text is not null")
    each = rows.mapInArrow(count, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source.

    Both are tables of ``bucket_counts``; ``buckets`` bounds what the driver gets.
    """
    counts = []
    for table in (source, target):
        n = [0] * buckets
        for r in table.collect():
            n[r["bucket"]] = r["n"]
        counts.append(n)
    own, wanted = counts
    all_own, all_wanted = sum(own) + buckets, sum(wanted) + buckets
    return np.array(
        [
            math.floor(1000 * math.log(float((t + 1) * all_own) / float((s + 1) * all_wanted)))
            for s, t in zip(own, wanted, strict=True)
        ],
        np.int64,
    )


def noise(key: int | None, seed: str) -> int:
    """floor(1000 g), g of the Gumbel distribution, from a hash of seed and key."""
    text = f"{seed}:{'' if key is None else key}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    df: DataFrame, gains: np.ndarray, seed: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def rows(docs):
        for d in docs:
            n_words = n_features = total = 0
            for n, found in feature_buckets(d["text"], len(gains)):
                n_words, n_features = n_words + n, n_features + len(found)
                total += int(gains[found].sum())
            weight = total // n_features if n_features else 0
            yield {
                "doc_id": d["doc_id"],
                "n_words": n_words,
                "n_features": n_features,
                "weight": weight,
                "score": weight + noise(d["doc_id"], seed),
            }

    given = df.select(
        named(doc_id).cast("long").alias("doc_id"),
        F.coalesce(named(text), F.lit("")).alias("text"),
    )
    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return arrow_map(given, rows, schema, 256)


# -- selection ---------------------------------------------------------------

KEY = ["a", "b", "row"]


def _before(pivot: tuple[int, int, int], equal: bool) -> Column:
    """Whether a row's key comes before the pivot (or is it)."""
    a, b, row = (F.col(c) for c in KEY)
    pa_, pb, pr = pivot
    last = row <= pr if equal else row < pr
    # The first part alone can be pushed down to the files.
    return (a <= pa_) & ((a < pa_) | (b < pb) | ((b == pb) & last))


def weighted_median(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """The lower median of the rows of ``keys`` counted ``sizes`` times, and all sizes."""
    order = np.lexsort(keys.T[::-1])
    sums = np.cumsum(sizes[order])
    at = int(np.searchsorted(sums, (sums[-1] + 1) // 2))
    return keys[order[at]], int(sums[-1])


def _medians(rows: DataFrame) -> tuple[tuple[int, int, int], int]:
    """Weighted median of the tasks' medians, which are those of their batches."""
    names = [*KEY, "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sizes = [], []
        for b in batches:
            if b.num_rows:
                keys = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
                middle, n = weighted_median(keys, np.ones(len(keys), np.int64))
                found.append(middle)
                sizes.append(n)
        if found:
            middle, n = weighted_median(np.array(found), np.array(sizes))
            both = [pa.array([int(x)], pa.int64()) for x in (*middle, n)]
            yield pa.record_batch(both, names=names)

    told = rows.select(*KEY).mapInArrow(run, ", ".join(f"{n} long" for n in names)).collect()
    middle, size = weighted_median(
        np.array([[r[c] for c in KEY] for r in told]), np.array([r["size"] for r in told])
    )
    return tuple(int(x) for x in middle), size


def cutoff(rows: DataFrame, n_rows: int, wanted: int) -> tuple[int, int, int] | None:
    """The key of place ``wanted`` (from 1) of the stored ``rows`` (a, b, row), ascending.

    None stands for no row at all.  Keys have to differ.
    """
    if not 0 < wanted <= n_rows:
        return None
    left, held = rows, n_rows
    while n_rows > FEW:
        pivot, _ = _medians(left)
        below = left.where(_before(pivot, True)).count()
        if below == wanted:
            return pivot
        if below > wanted:
            left, n_rows = left.where(_before(pivot, False)), below - 1
        else:
            left, n_rows, wanted = left.where(~_before(pivot, True)), n_rows - below, wanted - below
        if n_rows * 3 < held:  # what is gone need not be read again
            left, held = stored(left, "remaining"), n_rows
    few = sorted(tuple(r) for r in left.select(*KEY).collect())
    return few[wanted - 1]


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` in a global order, with their places from 1; no task sees more than a range."""
    at = F.monotonically_increasing_id()
    placed = stored(rows.orderBy(*order).withColumn("__at", at), "ordered")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per range.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"))
    place = F.col("__n") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(starts, "__part").withColumn(name, place).drop("__part", "__at", "__n")


def importance_resample(
    df: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    buckets: int = BUCKETS,
    seed: str = "7",
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row per row of ``df``.

    Of the N rows with ``min_words`` words or more, the floor(percent * N / 100) with the
    highest scores are drawn and have a rank from 1; ``rank`` is null for the others.  Ties
    go to the smaller key, null keys last, rows of one key and score in any order.  Null
    and empty texts have no features, weight 0, and are never drawn; null texts of the target
    add nothing.  Repeated rows are rows of their own.  A table may be empty; without target
    features the rarest buckets count most.  Texts of any length are counted part by part.
    Keys are integers; a null key takes part in the draw as if it were an empty string.
    """
    gains = log_ratios(
        bucket_counts(df, text, buckets), bucket_counts(target, target_text, buckets), buckets
    )
    each = scored(df, gains, seed, doc_id, text)
    each = each.select(
        "*",
        (-F.col("score")).alias("a"),
        F.coalesce("doc_id", F.lit(LAST)).alias("b"),
        F.monotonically_increasing_id().alias("row"),
    )
    each = stored(each, "scored")
    fit = each.where(F.col("n_words") >= min_words)
    n = fit.count()
    last = cutoff(fit, n, percent * n // 100)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return each.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= min_words) & _before(last, True)
    ranked = numbered(each.where(drawn).select(*columns, *KEY), KEY)
    rest = each.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(rest)
