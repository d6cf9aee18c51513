"""Language of a text by compression.

Each language has a zstandard dictionary of raw text from its labelled rows.  A text is
cut into short chunks, each chunk is compressed with every dictionary, and the
language whose chunks take the fewest bytes in all is the answer.  The chunks keep the
dictionary in reach all through a long text.  A narrow margin over the second-best
language is reported, so that a caller can reject the answer.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrec.llm.common import arrow_map, named, ship_package, texts

UNDETERMINED = "und"
CHUNK = 2048
LEVEL = 6
# The answer is rejected if the second language needs less than this share more.
NARROW = 0.002
LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """Lower case, with each run of other ASCII characters as one space."""
    return b" ".join(text.lower().encode().translate(_KEEP).split())


def fit_dictionaries(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    docs_per_language: int = 400,
    dictionary_bytes: int = 65_536,
    max_languages: int = 256,
) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample of labelled rows.

    Of the ``max_languages`` most frequent labels, the ``docs_per_language`` texts with the
    smallest hash each give a piece from a place among their letters that the hash chooses.
    Pieces are an even share of ``dictionary_bytes``, so that every sampled text teaches; a
    shorter text gives all its letters.  Equal texts of a label teach once.  Rows without
    label, or without a letter anywhere in their text, teach nothing.
    """
    rows = df.where(named(text).rlike(r"\p{L}") & named(lang).isNotNull()).select(
        named(lang).cast("string").alias("lang"),
        named(text).alias("text"),
        F.xxhash64(named(text)).alias("order"),
    )
    counts = rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.approx_count_distinct("order").alias("different")
    )
    learned = counts.orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    # Twice the texts wanted pass this, so that no group is much larger than the sample.
    shares = df.sparkSession.createDataFrame(
        [(r["lang"], 2.0 * docs_per_language / max(1, r["different"])) for r in learned],
        "lang string, share double",
    )
    low = F.col("order") / F.lit(2.0**64) + 0.5 <= F.col("share")
    few = rows.join(F.broadcast(shares), "lang").where(low).drop("share")  # max_languages rows
    clean = F.trim(F.regexp_replace(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+", " "))
    # Bytes are cut on the driver; no piece has more letters than bytes.
    room = F.floor(F.lit(dictionary_bytes) / F.least(F.lit(docs_per_language), "n"))
    spare = F.greatest(F.lit(0), F.length("clean") - F.col("room"))
    start = F.pmod(F.xxhash64("order"), spare + 1) + 1
    own = Window.partitionBy("lang")
    sample = (
        few.dropDuplicates(["lang", "order"])
        .withColumn("place", F.row_number().over(own.orderBy("order")))
        .withColumn("n", F.count("*").over(own))
        .where(F.col("place") <= docs_per_language)
        .select("lang", "place", "order", clean.alias("clean"), room.cast("int").alias("room"))
        .withColumn("piece", F.substr("clean", start.cast("int"), F.col("room")))
        .drop("clean", "order")
    )
    parts: dict[str, list[bytes]] = {r["lang"]: [] for r in learned}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["place"])):
        cut = letters(r["piece"])[: max(1, r["room"] - 1)]  # and a space between pieces
        parts[r["lang"]].append(cut.decode(errors="ignore").encode())
    return {k: b" ".join(v) for k, v in sorted(parts.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.compressors = {}
        for name, raw in dictionaries.items():
            content = zstandard.ZstdCompressionDict(
                raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            content.precompute_compress(compression_params=how)
            self.compressors[name] = zstandard.ZstdCompressor(
                dict_data=content, compression_params=how
            )

    def sizes(self, raw: bytes) -> list[tuple[int, str]]:
        chunks = [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]
        return sorted(
            (sum(len(c.compress(part)) for part in chunks), name)
            for name, c in self.compressors.items()
        )

    def classify(self, text: str) -> tuple[str, float]:
        """Language and margin: the share that the second-best takes more."""
        if not self.compressors or not LETTER.search(text):
            return UNDETERMINED, 0.0
        sizes = self.sizes(letters(text))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(
    df: DataFrame,
    dictionaries: dict[str, bytes],
    doc_id: str = "doc_id",
    text: str = "text",
    narrow: float = NARROW,
) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), a row per row of ``df``.

    ``lang_pred`` is ``und`` for a null text, one without a letter, or if nothing was
    learned; ``score`` is the margin, from 0 to 1; ``rejected`` is true for ``und`` and
    for margins below ``narrow``.  Ties go to the first name.  Whole texts are read.
    Repeated rows and null keys give a row each.
    """
    given = texts(df, doc_id, text)
    kind = given.schema[0].dataType.simpleString()

    def rows(docs):
        own = Classifier(dictionaries)
        for d in docs:
            name, margin = own.classify(d["text"])
            bad = name == UNDETERMINED or margin < narrow
            yield {"doc_id": d["doc_id"], "lang_pred": name, "score": margin, "rejected": bad}

    schema = f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    return arrow_map(given, rows, schema)


def drop_rejected(
    df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", narrow: float = NARROW
) -> DataFrame:
    """The rows of ``df``, with all their columns, whose language is not rejected.

    As ``identify`` decides it; nothing is moved between tasks.
    """
    ship_package(df.sparkSession)
    at = df.columns.index(text)

    def keep(batches):
        own = Classifier(dictionaries)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = (own.classify(t or "") for t in part.column(at).to_pylist())
                fine = [name != UNDETERMINED and margin >= narrow for name, margin in found]
                yield part.filter(pa.array(fine, pa.bool_()))

    return df.mapInArrow(keep, df.schema)
