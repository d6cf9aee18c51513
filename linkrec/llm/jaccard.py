"""Documents that share most of their word n-grams.

Two documents link if the Jaccard similarity of their n-gram sets reaches a threshold.
The steps, each of them exact:

1. Equal sets form classes; one member stands for all.
2. A set can only link if that share of its own n-grams also occurs in another document
   (a bound from its size).  Packed hashes of all n-grams meet in buckets, which tell
   each document how many of its n-grams occur elsewhere; most documents end here.
3. The rest order their n-grams from rare to common.  Of two sets that link, the first
   few n-grams (as many as the bound on their size allows to be missed, plus one) must
   have one in common.  Documents that share one of these are put into one region.
4. Within a region the product of the document by n-gram incidence matrix with its
   transpose, block by block, gives the overlap of every pair; sizes and overlap decide.
   A region too large for one task is cut into cells of member blocks: first every
   member meets some leaders, which joins nearly all of a group of near copies; then
   those outside the region's largest component meet every member.  So every pair that
   could still join two components is compared, and no group is expanded into its pairs.
5. Components of the links, with the classes put back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrec.llm import packed
from linkrec.llm.common import arrow_map, named, total_bytes
from linkrec.llm.components import components
from linkrec.storage import stored

WORDS = 5
PERCENT = 75
REMEMBERED = 150_000
BLOCK_HASHES = 1_000_000  # n-grams that a task packs at a time
REGION_HASHES = 1_000_000  # n-grams of a region, or of a block of it, in one task
LEADERS = 32
COLUMNS = 4096
# An unrelated odd multiplier for each place of a word.
MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"%d" % j) | 1 for j in range(64)], np.uint64)


class Shingler(dict):
    """Sorted distinct hashes of the word n-grams of a text."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # on [\x20\x09-\x0D]; lower() turns A-Z only
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            whole = b" ".join([b"%d" % len(words), *words])
            return np.array([xxhash.xxh3_64_intdigest(whole)], np.uint64)
        each = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        width = len(each) - self.n + 1
        out = np.zeros(width, np.uint64)
        for j in range(self.n):
            out += each[j : j + width] * MULTIPLIERS[j]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k, text): ``k`` stands for the key and text of a row together."""
    body = F.coalesce(named(text), F.lit(""))
    key = named(doc_id).cast("long")
    return df.select(key.alias("doc_id"), F.xxhash64(key, body).alias("k"), body.alias("text"))


def _needed(n: np.ndarray | int, percent: int):
    """The least overlap that a set of this size needs with any other."""
    return -(-n * percent // 100)


def shared_counts(given: DataFrame, n: int, bucket_bytes: int) -> DataFrame:
    """(doc_id, k, n_shingles, digest, n_shared), a row per row.

    ``n_shared`` counts the n-grams that also occur in another row's set, or more, as
    shortened hashes may collide.
    """
    size = total_bytes(given)
    width = packed.filter_width(size // 4)
    buckets = packed.n_buckets(size / 6 * width, bucket_bytes)
    cuts = packed.edges(buckets, width)

    def pack(docs):
        shingler = Shingler(n)
        own, senders, seen, held = [], [], {}, 0
        number = TaskContext.get().partitionId() << 24

        def flush(block: int):
            short = [packed.shorten(h, width) for _, h in senders]
            place = np.repeat(np.arange(len(short)), [len(h) for h in short])
            flat = np.concatenate(short) if short else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            flat, place = flat[order], place[order]
            starts = packed.group_starts(flat)
            sizes = np.diff(np.append(starts, len(flat)))
            single = np.repeat(sizes == 1, sizes)
            known = np.bincount(place[~single], minlength=len(short))
            for at, (row, _) in enumerate(senders):
                row |= {"known": int(known[at]), "at": at}
            here, whose = flat[single], place[single]
            for b, a, z in packed.slices(here, cuts):
                by_doc = np.argsort(whose[a:z], kind="stable")
                docs_at, counts = np.unique(whose[a:z], return_counts=True)
                yield {
                    "bucket": b,
                    "block": block,
                    "at": docs_at.astype("<u4").tobytes(),
                    "counts": counts.astype("<u4").tobytes(),
                    "hashes": packed.to_bytes(here[a:z][by_doc], width),
                }
            several = flat[starts[sizes > 1]]  # known to be shared; others have to learn it
            for b, a, z in packed.slices(several, cuts):
                yield {
                    "bucket": b,
                    "at": b"",
                    "counts": b"",
                    "hashes": packed.to_bytes(several[a:z], width),
                }
            yield {
                "bucket": block % buckets,
                "block": block,
                "at": b"",
                "counts": b"",
                "hashes": b"",
                "docs": [*own],
            }

        for d in docs:
            h = shingler.hashes(d["text"])
            digest = xxhash.xxh3_128_digest(h.tobytes())
            row = {"doc_id": d["doc_id"], "k": d["k"], "n": len(h), "digest": digest}
            if digest in seen:  # an equal set in this block speaks for it
                row |= {"known": len(h), "at": -1}
            else:
                seen[digest] = True
                senders.append((row, h))
                held += len(h)
            own.append(row)
            if held >= BLOCK_HASHES or len(own) >= 20_000:
                yield from flush(number)
                own, senders, seen, held, number = [], [], {}, 0, number + 1
        if own:
            yield from flush(number)

    doc = "struct<doc_id: long, k: long, n: int, digest: binary, known: int, at: int>"
    rows = arrow_map(
        given,
        pack,
        f"bucket int, block long, at binary, counts binary, hashes binary, docs array<{doc}>",
        64,
    )

    def meet(table: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in table.column("hashes")]
        flat = packed.from_bytes(b"".join(raw), width)
        shared = (packed.run_totals(flat) > 1).astype(np.int64)
        done, places, sums = 0, [], []
        for hashes, at, counts in zip(
            raw, *(table.column(c).to_pylist() for c in ("at", "counts")), strict=True
        ):
            end = done + len(hashes) // width
            place, sizes = np.frombuffer(at, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64)
            found = np.add.reduceat(shared[:end], done + np.cumsum(sizes) - sizes) if at else sizes
            places.append(place[found > 0].tobytes())
            sums.append(found[found > 0].astype("<u4").tobytes())
            done = end
        columns = {"at": pa.array(places, pa.binary()), "shared": pa.array(sums, pa.binary())}
        own = {c: table.column(c) for c in ("block", "docs")}
        return pa.table(own | columns).filter(pa.array([b is not None for b in own["block"].to_pylist()]))

    met = stored(
        rows.groupBy("bucket").applyInArrow(
            meet, f"block long, docs array<{doc}>, at binary, shared binary"
        ),
        "shared",
    )
    out = pa.schema(
        [("doc_id", pa.int64()), ("k", pa.int64()), ("n_shingles", pa.int32())]
        + [("digest", pa.binary()), ("n_shared", pa.int64())]
    )

    def gather(table: pa.Table) -> pa.Table:
        """A block's documents with what all buckets have told of them."""
        docs = [d for own in table.column("docs").to_pylist() for d in own or ()]
        told = np.zeros(len(docs) + 1, np.int64)
        for at, shared in zip(*(table.column(c).to_pylist() for c in ("at", "shared")), strict=True):
            told[np.frombuffer(at, "<u4")] += np.frombuffer(shared, "<u4")
        each = [
            {
                "doc_id": d["doc_id"],
                "k": d["k"],
                "n_shingles": d["n"],
                "digest": d["digest"],
                "n_shared": d["known"] + (int(told[d["at"]]) if d["at"] >= 0 else 0),
            }
            for d in docs
        ]
        return pa.Table.from_pylist(each, schema=out)

    return met.groupBy("block").applyInArrow(
        gather, "doc_id long, k long, n_shingles int, digest binary, n_shared long"
    )


def set_blocks(given: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(block, ks, ns, hashes): sets of the rows whose ``k`` is wanted, many in a row."""
    # The same plan at every size: texts are dealt by k, which the grouping needs as well.
    own = given.select("k", "text").join(wanted.select("k").hint("merge"), "k", "left_semi")
    own = own.groupBy("k").agg(F.first("text").alias("text"))

    def rows(docs):
        shingler, part, number = Shingler(n), TaskContext.get().partitionId(), 0
        ks, sets, held = [], [], 0

        def block():
            return {
                "block": part << 32 | number,
                "ks": ks,
                "ns": [len(h) for h in sets],
                "hashes": packed.to_bytes(np.concatenate(sets)),
            }

        for d in docs:
            sets.append(shingler.hashes(d["text"]))
            ks.append(d["k"])
            held += len(sets[-1])
            if held >= BLOCK_HASHES:
                yield block()
                ks, sets, held, number = [], [], 0, number + 1
        if ks:
            yield block()

    return arrow_map(own, rows, "block long, ks array<long>, ns array<int>, hashes binary", 16)


def region_links(blocks: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b): links that join all documents with a rare n-gram in common."""
    cuts = packed.edges(buckets)

    def count(rows):
        for d in rows:
            found, counts = np.unique(packed.from_bytes(d["hashes"]), return_counts=True)
            for b, a, z in packed.slices(found, cuts):
                yield {
                    "bucket": b,
                    "block": d["block"],
                    "hashes": packed.to_bytes(found[a:z]),
                    "counts": counts[a:z].astype("<u4").tobytes(),
                }

    def frequencies(table: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in table.column("hashes")]
        weights = b"".join(x.as_py() for x in table.column("counts"))
        flat = packed.from_bytes(b"".join(raw))
        total = packed.run_totals(flat, np.frombuffer(weights, "<u4").astype(np.int64))
        total, at, out = np.minimum(total, (1 << 32) - 1).astype("<u4"), 0, []
        for hashes in raw:
            end = at + len(hashes) // 8
            out.append(total[at:end].tobytes())
            at = end
        return pa.table(
            {"block": table.column("block"), "bucket": table.column("bucket"), "df": out}
        )

    counted = arrow_map(
        blocks, count, "bucket int, block long, hashes binary, counts binary", 64
    )
    known = counted.groupBy("bucket").applyInArrow(
        frequencies, "block long, bucket int, df binary"
    )
    out = pa.schema(
        [("bucket", pa.int32()), ("hashes", pa.binary()), ("ks", pa.binary()), ("kind", pa.int32())]
    )

    def rare(own: pa.Table, told: pa.Table) -> pa.Table:
        parts = sorted(
            zip(told.column("bucket").to_pylist(), told.column("df").to_pylist(), strict=True)
        )
        rows: list[dict] = []
        for ks, ns, raw in zip(*(own.column(c).to_pylist() for c in ("ks", "ns", "hashes")), strict=True):
            flat, keys = packed.from_bytes(raw), np.array(ks, np.int64)
            found = np.unique(flat)
            df = np.frombuffer(b"".join(x for _, x in parts), "<u4")[np.searchsorted(found, flat)]
            sizes = np.array(ns)
            place = np.repeat(np.arange(len(ks)), sizes)
            order = np.lexsort((flat, df, place))  # by document, then from rare to common
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = np.repeat(sizes - _needed(sizes, percent) + 1, sizes)
            keep = order[(rank < first) & (df[order] > 1)]
            pick, whose = flat[keep], keys[place[keep]]
            sort = np.lexsort((whose, pick))
            pick, whose = pick[sort], whose[sort]
            starts = packed.group_starts(pick)
            lead = np.repeat(whose[starts], np.diff(np.append(starts, len(pick))))
            pairs = np.unique(np.stack([whose, lead], 1)[whose != lead], axis=0)
            rows.append({"kind": 0, "hashes": pairs[:, 0].tobytes(), "ks": pairs[:, 1].tobytes()})
            for b, a, z in packed.slices(pick[starts], cuts):
                rows.append(
                    {
                        "bucket": b,
                        "kind": 1,
                        "hashes": packed.to_bytes(pick[starts][a:z]),
                        "ks": whose[starts][a:z].tobytes(),
                    }
                )
        return pa.Table.from_pylist(rows, schema=out)

    prefixes = stored(
        blocks.groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInArrow(rare, "bucket int, hashes binary, ks binary, kind int"),
        "prefixes",
    )
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def lead(table: pa.Table) -> pa.Table:
        flat = packed.from_bytes(b"".join(x.as_py() for x in table.column("hashes")))
        keys = np.frombuffer(b"".join(x.as_py() for x in table.column("ks")), np.int64)
        sort = np.lexsort((keys, flat))
        flat, keys = flat[sort], keys[sort]
        starts = packed.group_starts(flat)
        first = np.repeat(keys[starts], np.diff(np.append(starts, len(flat))))
        found = np.unique(np.stack([keys, first], 1)[keys != first], axis=0)
        return pa.table([found[:, 0], found[:, 1]], schema=pairs)

    def unpacked(rows):
        for d in rows:
            for a, b in zip(
                np.frombuffer(d["hashes"], np.int64).tolist(),
                np.frombuffer(d["ks"], np.int64).tolist(),
                strict=True,
            ):
                yield {"a": a, "b": b}

    inside = arrow_map(
        prefixes.where("kind = 0").select("hashes", "ks"), unpacked, "a long, b long"
    )
    across = prefixes.where("kind = 1").groupBy("bucket").applyInArrow(lead, "a long, b long")
    return inside.unionByName(across)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every left with every right set: a product of incidence matrices.

    Only n-grams found on both sides have columns; these are taken a block at a time.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        sides.append((flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    (a, row_a), (b, row_b) = sides
    common = np.intersect1d(a, b)
    pick_a, pick_b = np.isin(a, common), np.isin(b, common)
    a, row_a, b, row_b = a[pick_a], row_a[pick_a], b[pick_b], row_b[pick_b]
    col_a, col_b = np.searchsorted(common, a), np.searchsorted(common, b)
    sort_a, sort_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    row_a, col_a, row_b, col_b = row_a[sort_a], col_a[sort_a], row_b[sort_b], col_b[sort_b]
    for at in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - at)
        blocks = []
        for rows, cols, n in ((row_a, col_a, len(left)), (row_b, col_b, len(right))):
            lo, hi = np.searchsorted(cols, (at, at + width))
            block = np.zeros((n, width), np.float32)
            block[rows[lo:hi], cols[lo:hi] - at] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which left set links with which right one."""
    n, m = (np.array([len(s) for s in side], np.int64) for side in (left, right))
    small, large = np.minimum.outer(n, m), np.maximum.outer(n, m)
    may = 100 * small >= percent * large  # sizes alone rule out the rest
    if not may.any():
        return may
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    both = np.zeros(may.shape, np.int64)
    both[np.ix_(rows, cols)] = overlaps([left[i] for i in rows], [right[j] for j in cols])
    return may & (100 * both >= percent * (np.add.outer(n, m) - both))


LINKS = "a long, b long"


def _link_table(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(table: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    return table.column("k").to_pylist(), [
        packed.from_bytes(x.as_py()) for x in table.column("hashes")
    ]


def _forest(ks: list[int], found: np.ndarray) -> list[tuple[int, int]]:
    """As many of the links as join what they join."""
    root = list(range(len(ks)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(found, 1)), strict=True):
        x, y = top(int(i)), top(int(j))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ks[i], ks[j]))
    return out


def links_in_regions(sets: DataFrame, percent: int, region_hashes: int) -> DataFrame:
    """(a, b): enough links to join all that links join, from (region, k, n, hashes)."""
    sizes = sets.groupBy("region").agg(F.sum("n").alias("volume"), F.count("*").alias("members"))
    sizes = stored(sizes.where("members > 1"), "regions")
    # A region also is too large if its pairs are.
    fits = (F.col("volume") <= region_hashes) & (F.col("members") <= 2048)
    small = sets.join(sizes.where(fits).select("region"), "region")
    total = sizes.where(fits).agg(F.coalesce(F.sum("volume"), F.lit(0))).first()[0]
    bins = max(1, -(-total // region_hashes))

    def product(table: pa.Table) -> pa.Table:
        pairs: list[tuple[int, int]] = []
        table = table.sort_by("region")
        regions = table.column("region").to_numpy()
        starts = [*packed.group_starts(regions), len(regions)]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            ks, own = _sets(table.slice(a, z - a))
            pairs += _forest(ks, linked(own, own, percent))
        return _link_table(pairs)

    binned = small.withColumn("bin", F.pmod(F.xxhash64("region"), F.lit(bins)).cast("int"))
    links = binned.select("bin", "region", "k", "hashes").groupBy("bin").applyInArrow(product, LINKS)
    big = sizes.where(~fits).withColumn(
        "cells", F.ceil(F.greatest(F.col("volume") / region_hashes, F.col("members") / 1024))
    )
    if not big.limit(1).count():
        return links
    return stored(links.unionByName(_links_in_cells(sets.join(big, "region"), percent)), "links")


def _links_in_cells(members: DataFrame, percent: int) -> DataFrame:
    members = members.select(
        "region",
        "k",
        "hashes",
        "cells",
        F.pmod(F.xxhash64("k"), F.col("cells")).cast("int").alias("cell"),
    )
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("k", F.lit(1))))
    chosen = (
        members.select("region", "k").withColumn("place", place).where(F.col("place") <= LEADERS)
    )
    leaders = stored(members.join(chosen.select("k"), "k", "left_semi"), "leaders")
    everywhere = F.explode(F.sequence(F.lit(0), (F.col("cells") - 1).cast("int")))

    def meet_leaders(own: pa.Table, some: pa.Table) -> pa.Table:
        (ks, sets), (heads, head_sets) = _sets(own), _sets(some)
        pairs = []
        if ks and heads:
            for i, row in enumerate(linked(sets, head_sets, percent)):
                pairs += [(ks[i], heads[j]) for j in np.flatnonzero(row) if heads[j] != ks[i]]
        return _link_table(pairs)

    near = stored(
        members.groupBy("region", "cell")
        .cogroup(leaders.withColumn("cell", everywhere).groupBy("region", "cell"))
        .applyInArrow(meet_leaders, LINKS),
        "leader_links",
    )
    labels = components(near).withColumnRenamed("node", "k")
    labelled = members.join(labels, "k", "left").withColumn(
        "label", F.coalesce("label", F.col("k"))
    )
    labelled = stored(labelled, "labelled")
    counts = labelled.groupBy("region", "label").agg(F.count("*").alias("size"))
    main = counts.groupBy("region").agg(F.max(F.struct("size", "label")).alias("main"))
    rest = labelled.join(main, "region").where("label <> main.label").drop("main")
    amount = rest.groupBy("region").agg(F.count("*").alias("n_rest"))
    sets = rest.join(amount, "region").withColumn(
        "turns", F.ceil(F.col("n_rest") / 1024).cast("int")
    )
    sets = stored(
        sets.withColumn("turn", F.pmod(F.xxhash64("k", F.lit(2)), F.col("turns")).cast("int")),
        "outside",
    )
    turns = sets.select("region", "turns").distinct()
    against = labelled.join(turns, "region").withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))
    )

    def meet_all(own: pa.Table, some: pa.Table) -> pa.Table:
        (ks, all_sets), (others, other_sets) = _sets(own), _sets(some)
        pairs = []
        if ks and others:
            label = np.array(own.column("label").to_pylist())
            label_of = some.column("label").to_pylist()
            for i, column in enumerate(linked(all_sets, other_sets, percent).T):
                found = np.flatnonzero(column & (label != label_of[i]))
                # One link to each component is enough to join it.
                _, first = np.unique(label[found], return_index=True)
                pairs += [(ks[j], others[i]) for j in found[first]]
        return _link_table(pairs)

    keys = ["region", "cell", "turn"]
    far = against.select(*keys, "k", "hashes", "label").groupBy(*keys).cogroup(
        sets.withColumn("cell", everywhere).select(*keys, "k", "hashes", "label").groupBy(*keys)
    )
    return near.unionByName(far.applyInArrow(meet_all, LINKS))


def similar_groups(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = WORDS,
    percent: int = PERCENT,
    bucket_bytes: int = packed.BUCKET_BYTES,
    region_hashes: int = REGION_HASHES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, row_hash), a row per row of ``df``.

    Words are separated by ASCII white space, A-Z count as a-z.  A text of fewer than
    ``n`` words has them all as its one n-gram; one without words, or null, has none and
    links with nothing.  Two rows link if 100 * intersection >= ``percent`` * union.
    ``component_id`` is the smallest key reachable by links, the row's own included; null
    keys count only where there is no other.  Rows that repeat a key are rows of their
    own.  Sets are compared by 64-bit hashes of n-grams.  ``row_hash`` stands for key and
    text.  An empty table gives an empty result.
    """
    if not 1 <= n <= len(MULTIPLIERS):
        raise ValueError("n is out of range")
    given = keyed(df, doc_id, text)
    rows = stored(shared_counts(given, n, bucket_bytes), "sizes")
    classes = stored(
        rows.where("n_shingles > 0")
        .groupBy("digest", "n_shingles")
        .agg(
            F.min("k").alias("k"),
            F.min("doc_id").alias("least"),
            F.max("n_shared").alias("n_shared"),
        ),
        "classes",
    )
    wanted = classes.where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    blocks = stored(set_blocks(given, wanted, n), "sets")
    volume = wanted.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    near = region_links(blocks, percent, packed.n_buckets(12 * volume, bucket_bytes))
    regions = components(near)

    def unpacked(rows):
        for d in rows:
            at = 0
            for k, size in zip(d["ks"], d["ns"], strict=True):
                yield {"k": k, "n": size, "hashes": d["hashes"][8 * at : 8 * (at + size)]}
                at += size

    sets = arrow_map(blocks, unpacked, "k long, n int, hashes binary", 256)
    sets = sets.join(regions.toDF("k", "region"), "k")
    labels = components(links_in_regions(sets, percent, region_hashes))
    grouped = classes.join(labels.toDF("k", "label"), "k", "left").withColumn(
        "label", F.coalesce("label", F.col("k"))
    )
    grouped = stored(grouped.select("digest", "n_shingles", "least", "label"), "grouped")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    known = stored(
        grouped.join(least, "label").select("digest", "n_shingles", "component_id"), "least"
    )
    return rows.join(known, ["digest", "n_shingles"], "left").select(
        "doc_id",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(F.col("n_shingles") == 0, F.col("doc_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
        F.col("k").alias("row_hash"),
    )
