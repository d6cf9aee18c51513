"""Class-based n-gram language model after Brown et al., clustered by exchange.

Each word belongs to one class; a text's probability is the product over its tokens of
class transition times word emission, mixed with the smoothed unigram so that every word
has a chance.  Classes start from word endings and improve by exchange rounds: all words
move at once to the class that makes their neighbours' classes most likely, given the
class counts of the round before.  The class transitions after a round tell the likelihood
of all that teaches; a round that lowers it is taken back, and rounds end when they gain
little.

Nothing of the vocabulary's size is ever in one place.  Tasks cut the corpus into blocks
of about half a million tokens, written once: the distinct words of the block as hashes, and
its tokens as bit-packed places among them.  Blocks send what they know of each word to
the word's bucket and get back its count and class, in the order of their own words; only
the matrix of class transitions, whose size is a parameter, is known everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrec.llm import packed
from linkrec.llm.common import arrow_map, named, total_bytes
from linkrec.llm.token_files import pack, unpack
from linkrec.storage import fresh_path, stored

CLASSES = 48
# Exchange rounds at most, and the least gain in nats a token for which another one is made.
ROUNDS = 4
LEAST_GAIN = 0.02
# Share of the class model in the mixture with the unigram.
WEIGHT = 0.8
BLOCK_TOKENS = 1 << 19
REMEMBERED = 200_000
# Words of a bucket whose neighbours' classes are laid out at once.
WORDS_AT_ONCE = 4_096
BUCKET_BYTES = 8 << 20
END = 0  # the class of the end token, which no word can have


class Words(dict):
    """Hash of a word; the lowest byte is the class it starts in, by its ending."""

    def __init__(self, classes: int):
        super().__init__()
        self.classes = classes
        self.end = xxhash.xxh3_64_intdigest(b"") >> 8 << 8 | END

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        ending = 1 + xxhash.xxh3_64_intdigest(word[-2:]) % (self.classes - 1)
        self[word] = h = xxhash.xxh3_64_intdigest(word) >> 8 << 8 | ending
        return h

    def hashes(self, text: str) -> np.ndarray:
        """Tokens of a text; A-Z count as a-z, words are cut at ASCII white space."""
        words = text.encode().lower().split()
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = self.end
        return out


def corpus_blocks(given: DataFrame, classes: int) -> DataFrame:
    """The corpus as a table of blocks, bucketed by block.

    A document too large for a block goes on in the next one; each part is led by the
    token before it, the first one by an end token.
    """

    def rows(docs: Iterator[dict]) -> Iterator[dict]:
        words = Words(classes)
        part = TaskContext.get().partitionId()
        number = held = 0
        heads: list[dict] = []
        parts: list[np.ndarray] = []

        def block() -> dict:
            flat = np.concatenate(parts)
            found, place = np.unique(flat, return_inverse=True)
            bits = max(1, (len(found) - 1).bit_length())
            sizes = np.array([len(p) for p in parts])
            learn = np.repeat([not h["held_out"] for h in heads], sizes)
            learn[np.cumsum(sizes) - sizes] = False  # leads are counted where they stand
            counts = np.bincount(place[learn], minlength=len(found))
            return {
                "block": part << 24 | number,
                "docs": heads,
                "sizes": sizes.astype("<u4").tobytes(),
                "words": packed.to_bytes(found),
                "counts": counts.astype("<u4").tobytes(),
                "bits": bits,
                "tokens": pack(place, bits),
            }

        for row, d in enumerate(docs):
            tokens = words.hashes(d["text"])
            lead = words.end
            head = {"row": part << 33 | row, "doc_id": d["doc_id"], "held_out": d["held_out"]}
            for at in range(0, len(tokens), BLOCK_TOKENS):
                piece = tokens[at : at + BLOCK_TOKENS]
                parts.append(np.concatenate([np.array([lead], np.uint64), piece]))
                heads.append(head)
                lead = piece[-1]
                held += len(piece)
                if held >= BLOCK_TOKENS:
                    yield block()
                    number, held, heads, parts = number + 1, 0, [], []
        if parts:
            yield block()

    doc = "struct<row: long, doc_id: long, held_out: boolean>"
    blocks = arrow_map(
        given,
        rows,
        f"block long, docs array<{doc}>, sizes binary, words binary, counts binary, bits int, "
        "tokens binary",
        64,
    )
    spark = given.sparkSession
    name, path = f"linkrec_{uuid.uuid4().hex}", fresh_path(spark, "blocks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = blocks.write.bucketBy(buckets, "block").option("path", path)
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


class BlockView:
    """A block's tokens, and masks over them."""

    def __init__(self, d: dict):
        self.docs = d["docs"]
        self.words = packed.from_bytes(d["words"])
        self.sizes = np.frombuffer(d["sizes"], "<u4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = unpack(d["tokens"], d["bits"], 0, int(self.sizes.sum())).astype(np.int64)
        self.learn = np.repeat([not h["held_out"] for h in self.docs], self.sizes)
        self.lead = np.zeros(len(self.tokens), bool)
        self.lead[self.starts] = True

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of a token and the one after it, in documents that teach."""
        second = np.flatnonzero(self.learn & ~self.lead)
        return second - 1, second

    def classes(self, told) -> np.ndarray:
        """Class of each distinct word: as told by the buckets, or by its ending."""
        if told is None:
            return (self.words & np.uint64(255)).astype(np.uint8)
        return np.frombuffer(_joined(told), np.uint8)


def _joined(told) -> bytes:
    """What the buckets told, in the order of the block's words."""
    return b"".join(x["data"] for x in sorted(told, key=lambda x: x["bucket"]))


TOLD = "block long, bucket int, data binary, v long, n long"


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, led by that width."""
    top = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _counts(told) -> np.ndarray:
    """What ``packed_counts`` of the buckets tell, in the order of the block's words."""
    parts = [x["data"] for x in sorted(told, key=lambda x: x["bucket"])]
    each = [np.frombuffer(p, f"<u{p[0]}", offset=1).astype(np.int64) for p in parts]
    return np.concatenate(each)


def _by_block(told: DataFrame, name: str) -> DataFrame:
    kept = told.where("block is not null").groupBy("block")
    return kept.agg(F.collect_list(F.struct("bucket", "data")).alias(name))


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """TOLD rows: the count of each word of a block in all that teaches, packed.

    A row without a block has the number of distinct words (v) and of tokens (n).
    """
    cuts = packed.edges(buckets)

    def ask(rows):
        for d in rows:
            words = packed.from_bytes(d["words"])
            counts = np.frombuffer(d["counts"], "<u4")
            for b, a, z in packed.slices(words, cuts):
                yield {
                    "bucket": b,
                    "block": d["block"],
                    "words": packed.to_bytes(words[a:z]),
                    "counts": counts[a:z].tobytes(),
                }

    def answer(table: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in table.column("words")]
        counts = b"".join(x.as_py() for x in table.column("counts"))
        counts = np.frombuffer(counts, "<u4").astype(np.int64)
        words = packed.from_bytes(b"".join(raw))
        total = packed.run_totals(words, counts)
        _, first = np.unique(words, return_index=True)
        out, at = [], 0
        for part in raw:
            end = at + len(part) // 8
            out.append(packed_counts(total[at:end]))
            at = end
        rows = table.num_rows
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
                "bucket": pa.array([table.column("bucket")[0].as_py()] * (rows + 1), pa.int32()),
                "data": pa.array([*out, b""], pa.binary()),
                "v": pa.array([0] * rows + [int((total[first] > 0).sum())], pa.int64()),
                "n": pa.array([0] * rows + [int(counts.sum())], pa.int64()),
            }
        )

    asked = arrow_map(
        blocks.select("block", "words", "counts"),
        ask,
        "bucket int, block long, words binary, counts binary",
        64,
    )
    return stored(asked.groupBy("bucket").applyInArrow(answer, TOLD), "counts")


def transitions(blocks: DataFrame, classes: int) -> np.ndarray:
    """How often a class follows another, over all that teaches."""

    def count(rows):
        for d in rows:
            view = BlockView(d)
            own = view.classes(d["told"]).astype(np.int64)[view.tokens]
            first, second = view.steps()
            pairs = np.bincount(own[first] * classes + own[second], minlength=classes**2)
            for pair in np.flatnonzero(pairs).tolist():
                yield {"pair": pair, "n": int(pairs[pair])}

    rows = arrow_map(blocks.drop("counts", "seen"), count, "pair int, n long")
    out = np.zeros(classes**2)
    for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # classes ** 2 at most
        out[r["pair"]] = r["n"]
    return out.reshape(classes, classes)


def exchange(blocks: DataFrame, matrix: np.ndarray, buckets: int) -> DataFrame:
    """TOLD rows: the class that each word of a block moves to, as u8."""
    classes = len(matrix)
    cuts = packed.edges(buckets)
    smooth = matrix + 0.5
    follow = np.log(smooth / smooth.sum(axis=1, keepdims=True))  # P(b | c) at [c, b]
    weight = np.log(smooth.sum(axis=0))

    def ask(rows):
        for d in rows:
            view = BlockView(d)
            own = view.classes(d["told"]).astype(np.int64)[view.tokens]
            first, second = view.steps()
            left = view.tokens[second] * 2 * classes + own[first]
            right = view.tokens[first] * 2 * classes + classes + own[second]
            keys, counts = np.unique(np.concatenate([left, right]), return_counts=True)
            word, near = keys // (2 * classes), (keys % (2 * classes)).astype(np.uint8)
            sizes = np.bincount(word, minlength=len(view.words))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for b, a, z in packed.slices(view.words, cuts):
                at = slice(int(ends[a]), int(ends[z]))
                yield {
                    "bucket": b,
                    "block": d["block"],
                    "words": packed.to_bytes(view.words[a:z]),
                    "sizes": sizes[a:z].astype("<u2").tobytes(),
                    "near": near[at].tobytes(),
                    "counts": counts[at].astype("<u4").tobytes(),
                }

    def answer(table: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in table.column("words")]
        words = packed.from_bytes(b"".join(raw))
        found, place = np.unique(words, return_inverse=True)
        join = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), kind)
        entry = np.repeat(place, join("sizes", "<u2")).astype(np.int32)
        order = np.argsort(entry, kind="stable")
        entry, near, counts = entry[order], join("near", np.uint8)[order], join("counts", "<u4")[order]
        best = np.empty(len(found), np.uint8)
        # Some words at a time, as each has a row of all classes on either side.
        for a in range(0, len(found), WORDS_AT_ONCE):
            n = min(WORDS_AT_ONCE, len(found) - a)
            lo, hi = np.searchsorted(entry, [a, a + n])
            context = np.bincount(
                (entry[lo:hi].astype(np.int64) - a) * 2 * classes + near[lo:hi],
                weights=counts[lo:hi],
                minlength=n * 2 * classes,
            ).reshape(-1, 2 * classes)
            left, right = context[:, :classes], context[:, classes:]
            gain = left @ follow + right @ follow.T - left.sum(axis=1, keepdims=True) * weight
            gain[:, END] = -np.inf
            best[a : a + n] = np.argmax(gain, axis=1)
        end = (found & np.uint64(255)) == END
        best[end] = END
        told, out, at = best[place], [], 0
        for part in raw:
            out.append(told[at : at + len(part) // 8].tobytes())
            at += len(part) // 8
        none = pa.array([None] * len(raw), pa.int64())
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                "data": pa.array(out, pa.binary()),
                "v": none,
                "n": none,
            }
        )

    asked = arrow_map(
        blocks.drop("counts", "seen"),
        ask,
        "bucket int, block long, words binary, sizes binary, near binary, counts binary",
        64,
    )
    return stored(asked.groupBy("bucket").applyInArrow(answer, TOLD), "classes")


def mutual_information(matrix: np.ndarray) -> float:
    """Nats that the class of a token tells of the next one's class, on average.

    The log likelihood per token of all that teaches, under the counts as they are, is this
    less the entropy of words, which no change of classes touches.
    """
    share = matrix / max(1.0, matrix.sum())
    alone = np.outer(share.sum(axis=1), share.sum(axis=0))
    some = share > 0
    return float((share[some] * np.log(share[some] / alone[some])).sum())


def fit_classes(
    blocks: DataFrame,
    classes: int = CLASSES,
    rounds: int = ROUNDS,
    buckets: int = 1,
    least_gain: float = LEAST_GAIN,
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """The blocks with the classes of their words (``told``), the transitions between these,
    and the mutual information at the start and after each round that was kept."""
    now = blocks.withColumn("told", F.lit(None).cast("array<struct<bucket: int, data: binary>>"))
    matrix = transitions(now, classes)
    gained = [mutual_information(matrix)]
    for _ in range(rounds):
        told = exchange(now, matrix, buckets)
        moved = blocks.join(_by_block(told, "told").hint("shuffle_hash"), "block")
        after = transitions(moved, classes)
        gain = mutual_information(after) - gained[-1]
        if gain < 0:
            break
        now, matrix = moved, after
        gained.append(gained[-1] + gain)
        if gain < least_gain:
            break
    return now, matrix, gained


def score_texts(
    df: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    classes: int = CLASSES,
    rounds: int = ROUNDS,
    weight: float = WEIGHT,
    bucket_bytes: int = BUCKET_BYTES,
    least_gain: float = LEAST_GAIN,
) -> DataFrame:
    """A row per row of ``df``, by a model of the rows that are not ``held_out``.

    Columns: doc_id, held_out, n_tokens (words and one end), n_known (tokens that training
    texts have), train_tokens, base_score (log10 probability by add-0.5 unigrams), score
    (by the class model) and perplexity (per token, by the class model).

    A word that training texts lack only has its share of the unigram, and leaves the
    context as it is.  Null and empty texts are an end token alone.  Null keys are kept;
    whether they are held out is up to ``held_out``.  Repeated rows are scored, and taught
    from, each.  An empty table gives an empty result.  There are at most ``rounds`` exchange
    rounds; they end before with one that gains less than ``least_gain``.  A very long text is
    cut into blocks that are scored apart.
    """
    if not 2 <= classes <= 127:
        raise ValueError("classes have to fit one byte, for either side")
    given = df.select(
        named(doc_id).cast("long").alias("doc_id"),
        F.coalesce(named(text), F.lit("")).alias("text"),
        held_out.alias("held_out"),
    )
    blocks = corpus_blocks(given, classes)
    buckets = packed.n_buckets(total_bytes(given) / 3, bucket_bytes)
    counted = word_counts(blocks, buckets)
    total = counted.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    v, n = total["v"] or 0, total["n"] or 0
    now, matrix, _ = fit_classes(blocks, classes, rounds, buckets, least_gain)
    seen = _by_block(counted, "seen").hint("shuffle_hash")
    scored = _scores(now.join(seen, "block"), matrix, v, n, weight)
    return (
        scored.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base_score").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(n).cast("long").alias("train_tokens"),
            "base_score",
            "score",
            F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
        )
    )


def _scores(blocks: DataFrame, matrix: np.ndarray, v: int, n: int, weight: float) -> DataFrame:
    smooth = matrix + 0.5
    follow = smooth / smooth.sum(axis=1, keepdims=True)
    size = matrix.sum(axis=0)  # tokens of each class
    below = n + 0.5 * (v + 1)

    def rows(given):
        for d in given:
            view = BlockView(d)
            count = _counts(d["seen"]).astype(np.float64)[view.tokens]
            own = view.classes(d["told"]).astype(np.int64)[view.tokens]
            base = (count + 0.5) / below
            known = count > 0
            # The class before: that of the last known token, of the end at the start.
            at = np.arange(len(own))
            lead = np.repeat(view.starts, view.sizes)
            last = np.maximum(np.maximum.accumulate(np.where(known, at, 0)), lead)
            before = np.concatenate([[0], last[:-1]])
            context = np.where(known[before], own[before], END)
            emit = np.divide(count, size[own], out=np.zeros(len(own)), where=size[own] > 0)
            mixed = weight * follow[context, own] * emit + (1 - weight) * base
            each = ~view.lead
            sums = [
                np.add.reduceat(np.where(each, x, 0), view.starts)
                for x in (np.ones(len(own), np.int64), known.astype(np.int64))
                + (np.log10(base), np.log10(mixed))
            ]
            for i, doc in enumerate(view.docs):
                yield doc | {
                    "n_tokens": int(sums[0][i]),
                    "n_known": int(sums[1][i]),
                    "base_score": float(sums[2][i]),
                    "score": float(sums[3][i]),
                }

    return arrow_map(
        blocks.drop("counts"),
        rows,
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, "
        "base_score double, score double",
    )

