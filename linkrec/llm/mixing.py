"""Mixing sources to target weights by a Pfair schedule.

The documents of each source, in hash order, form blocks.  Block j of a source with
share w of the mix may start at slot floor((j - 1) / w) and must be done by slot
ceil(j / w); each slot goes to the released block with the earliest deadline.  So at
every slot every source is less than one block from its target.  With whole-number
weights the schedule repeats after as many slots as the weights sum up to: one period is
worked out, and every block's slot follows from its number.  The only thing a document
needs is its place in its source, which is counted in two steps, so that a source of
any size is spread over many tasks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrec.llm.common import named
from linkrec.storage import stored

BLOCK = 16
# Rows that one task numbers.
ROWS_PER_TASK = 50_000
ALPHA = 0.7
PARTS = 1000
# The schedule is worked out by the driver, which is fit for this many sources.
MAX_SOURCES = 100_000


def tempered_weights(
    counts: dict[str, int], alpha: float = ALPHA, parts: int = PARTS
) -> dict[str, int]:
    """Whole-number weights in proportion to count ** alpha, each at least 1.

    They sum up to ``parts``, or to more where many sources need their least weight.
    """
    total = sum(n**alpha for n in counts.values())
    exact = {s: parts * n**alpha / total for s, n in counts.items()}
    weights = {s: max(1, int(x)) for s, x in exact.items()}
    left = parts - sum(weights.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, left)]:
        weights[s] += 1
    return weights


def pfair_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period, as many as the weights sum up to."""
    period = sum(weights.values())
    release: dict[int, list[tuple[int, str, int]]] = {}
    for s, w in weights.items():
        for j in range(1, w + 1):
            # floor((j - 1) / share) and ceil(j / share), in whole numbers
            start, deadline = (j - 1) * period // w, -(-j * period // w)
            release.setdefault(start, []).append((deadline, s, j))
    slots: dict[str, list[int]] = {s: [] for s in weights}
    ready: list[tuple[int, str, int]] = []
    for slot in range(period):
        for block in release.get(slot, ()):
            heapq.heappush(ready, block)
        deadline, s, _ = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block misses its deadline")
        slots[s].append(slot)
    return slots


def ranked_in_source(keyed: DataFrame, n_rows: int, rows_per_task: int) -> DataFrame:
    """``keyed`` (source, order, row_no, ...) with ``place``, from 0, in each source.

    Ranges of the hash are counted first; then rows are numbered inside each range.
    """
    bits = max(0, (max(1, n_rows // rows_per_task)).bit_length())
    parted = keyed.withColumn("part", F.shiftright("order", 64 - bits) if bits else F.lit(0))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )  # a row per source and range
    starts = (
        parted.groupBy("source", "part")
        .agg(F.count("*").alias("n"))
        .select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("source", "part").orderBy("order", "doc_id", "row_no")
    numbered = parted.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["source", "part"]).withColumn(
        "place", F.col("start") + F.col("inside")
    )


def mix(
    df: DataFrame,
    weights: dict[str, int] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    block: int = BLOCK,
    alpha: float = ALPHA,
    parts: int = PARTS,
    rows_per_task: int = ROWS_PER_TASK,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """(doc_id, source, place, slot, in_mix), a row per row of ``df``.

    ``place`` is the row's place in its source in hash order of the keys, ``slot`` that of
    its block in the schedule.  ``in_mix`` is true for slots before the first one at which
    a source has run out, so those rows have the target weights; the rest is the surplus
    of sources that have more than their share.  It has slots as well: those of sources that
    have run out stay empty and the others keep their weights among each other.  Sorted by
    (slot, place) the rows are the mix, all of them or those with ``in_mix``.

    ``weights`` are positive whole numbers; without them, shares go with
    count ** ``alpha``.  Sources not named in ``weights`` are not scheduled: slot is null,
    in_mix false.  A null source is the source ''.  Rows of a null key are ordered by
    their place in the input; repeated rows are ordered one after the other.  Sources,
    their counts and one period of slots are held by the driver and sent to all tasks, so
    more than ``max_sources`` of them, or weights that sum up to more than twice that, are
    refused; all else is spread by source and hash.
    """
    keyed = stored(
        df.select(
            named(doc_id).alias("doc_id"), F.coalesce(named(source), F.lit("")).alias("source")
        )
        .withColumn("row_no", F.monotonically_increasing_id())
        .withColumn("order", F.xxhash64(F.coalesce(F.col("doc_id"), F.col("row_no")))),
        "keys",
    )
    found = keyed.groupBy("source").agg(F.count("*").alias("n")).limit(max_sources + 1)
    counts = {r["source"]: r["n"] for r in found.collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources: group them before mixing")
    if weights is None:
        weights = tempered_weights(counts, alpha, parts) if counts else {}
    if any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights are positive whole numbers")
    period = sum(weights.values())
    if period > 2 * max(max_sources, PARTS):
        raise ValueError("the weights sum up to more slots than the driver is to hold")
    slots = pfair_period(weights)
    ends = []
    for s, own in slots.items():
        turn, at = divmod(-(-counts.get(s, 0) // block), weights[s])
        ends.append(turn * period + own[at])
    horizon = min(ends, default=0)
    table = df.sparkSession.createDataFrame(
        [(s, int(weights[s]), own) for s, own in slots.items()],
        "source string, weight int, slots array<int>",
    )
    ranked = ranked_in_source(keyed, sum(counts.values()), rows_per_task)
    number = F.floor(F.col("place") / block)
    turn, at = F.floor(number / F.col("weight")), F.pmod(number, F.col("weight")).cast("int")
    slot = turn * period + F.get("slots", at)
    # The table holds ``period`` slots, which is bounded above.
    return (
        ranked.join(F.broadcast(table), "source", "left")
        .withColumn("slot", slot.cast("long"))
        .select(
            "doc_id",
            "source",
            "place",
            "slot",
            F.coalesce(F.col("slot") < horizon, F.lit(False)).alias("in_mix"),
        )
    )
