"""From raw documents to token ids: five stages, each by one of the text operators.

Rows are told apart by ``k``, a hash of key and text, so rows that repeat a key with
another text are rows of their own.  Extra columns go along until the last stage.
"""

from __future__ import annotations

from importlib import import_module

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkrec.llm import bpe, common, exact_dedup, jaccard, langid, mixing
from linkrec.storage import stored

ROW, FILE = "__row", "__file"  # names that no table of ours has


def row_hash() -> Column:
    """The hash of key and text that the operators give as ``row_hash``."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose hash is in ``dropped`` (k)."""
    keyed = docs.withColumn(ROW, row_hash())
    return keyed.join(dropped.withColumnRenamed("k", ROW), ROW, "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letters or no clear language; null texts go as well."""
    learn = docs.where(~common.held_out(F.col("doc_id"), 4, 2))
    return langid.drop_rejected(docs, langid.fit_dictionaries(learn))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal without white space.

    That is the longest, then the one with the smallest key; of repeated rows, any one.
    """
    rows = exact_dedup.exact_groups(docs).select(F.col("row_hash").alias("k"), "kept")
    each = stored(
        rows.groupBy("k").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "decided"
    )
    left = without(docs, each.where("not kept").select("k"))
    if not each.where("kept and n > 1").limit(1).count():
        return left
    keyed = left.withColumn(ROW, row_hash())
    return keyed.dropDuplicates([ROW]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest key of each group of similar texts.

    Texts without words stay, and rows without a key unless one with a key is similar.
    """
    rows = stored(jaccard.similar_groups(docs), "similar")
    groups = rows.where("n_shingles > 0 and component_id is not null")
    # Null keys would come first in a struct; a group without any key has no component_id.
    first = groups.where("doc_id is not null").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "row_hash")).alias("m")
    )
    kept = first.select(F.col("m.row_hash").alias("k"))
    dropped = groups.select(F.col("row_hash").alias("k")).join(kept, "k", "left_anti").distinct()
    return without(docs, stored(dropped, "near_copies"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the schedule of target weights.

    Once a source has run out its slots stay empty, and the others go on at their weights.
    """
    keyed = docs.withColumn(ROW, row_hash())
    mixed = mixing.mix(keyed, doc_id=ROW)
    places = mixed.groupBy(F.col("doc_id").alias(ROW)).agg(
        F.min(F.struct("slot", "place")).alias("__at")
    )
    return keyed.join(stored(places, "places"), ROW).orderBy("__at").select(*docs.columns)


def in_written_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``: each row's place, from 0, in the order it was written in.

    A sorted table keeps its order in the numbers of its files and the rows in these.  Rows
    that are not read from files have places that only rise in the order of the partitions.
    """
    try:
        placed = docs.select(
            "*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(ROW)
        )
    except AnalysisException:
        return docs.withColumn("position", F.monotonically_increasing_id())
    number = F.regexp_extract(FILE, r"^part-(\d+)", 1).try_cast("long")
    before = Window.orderBy(number, FILE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(FILE)
        .agg(F.count("*").alias("n"))  # a row per file
        .select(FILE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("position"))
    )
    return placed.join(F.broadcast(starts), FILE).select(
        *docs.columns, (F.col("position") + F.col(ROW)).alias("position")
    )


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, position, n_tokens, token_ids, decoded_sha256): ids of each text, their place
    in the mix, and what they decode to.

    Training reads the rows by ``position``, which is the order of the schedule.
    """
    path = import_module("public_tokenizers").path("byte_bpe_50k.json")
    keyed = in_written_order(docs).withColumn(ROW, F.struct("doc_id", "position"))
    decoded = bpe.encode(keyed, path, doc_id=ROW, decoded=True)
    return decoded.select(
        "doc_id.doc_id",
        "doc_id.position",
        F.floor(F.octet_length("token_ids") / 4).alias("n_tokens"),
        "token_ids",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_texts),
]

# Compression, fingerprints and encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
