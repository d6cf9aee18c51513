"""Text sources and sinks: friend lists, profiles, recommendation lines.

A line that does not parse stops the job.  With ``on_bad="skip"`` such lines are left
out instead; an ``Observation`` counts them in the same pass, and ``rejected_*`` returns
them.  ``sorted_*`` reads and parses once and writes both kinds side by side.

In a session in which an ``Observation`` has been used, Spark 4.1 cannot fit trees any more
("Task not serializable: ObservationManager"); ``sorted_*`` needs none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkrec.functions.relations import normalize
from linkrec.schemas import PROFILES
from linkrec.storage import fresh_path, write_once

# Fixed value: a list entry ends and the next begins with this pattern.
ENTRY_BREAK = r"\),\("


def _int_or_zero(fields: Column, index: int, type_name: str) -> Column:
    """A field as a number; a missing or empty one is 0, garbage is NULL."""
    text = F.coalesce(F.get(fields, F.lit(index)), F.lit(""))
    return F.when(text == "", F.lit(0).cast(type_name)).otherwise(text.try_cast(type_name))


def _whole_lines(parsed: DataFrame, on_bad: str, rejects: Observation | None) -> DataFrame:
    """Rows with ``is_whole``; others stop the job or are counted as ``rejected``."""
    if on_bad == "fail":
        bad = F.raise_error(F.concat(F.lit("cannot read line: "), "value")).cast("boolean")
        return parsed.where(F.when(F.col("is_whole"), F.lit(True)).otherwise(bad))
    if on_bad != "skip":
        raise ValueError('on_bad is "fail" or "skip"')
    if rejects is not None:
        parsed = parsed.observe(rejects, F.count_if(~F.col("is_whole")).alias("rejected"))
    return parsed.where("is_whole")


def _both_kinds(parsed: DataFrame, path: str | None) -> tuple[DataFrame, DataFrame]:
    """Write ``parsed`` in one pass, parted by ``is_whole``: its whole rows, and other lines.

    Whole rows leave their line out, other lines their fields.  A table that a run has
    finished at ``path`` is read as it is.
    """
    spark = parsed.sparkSession
    whole = F.col("is_whole")
    fields = [c for c in parsed.columns if c not in ("value", "is_whole")]
    kinds = parsed.select(
        *[F.when(whole, F.col(c)).alias(c) for c in fields],
        F.when(~whole, F.col("value")).alias("value"),
        "is_whole",
    )
    if path is None:
        path = fresh_path(spark, "lines")
    write_once(kinds, path, ["is_whole"])
    back = spark.read.schema(kinds.schema).parquet(path)
    return back.where("is_whole").select(*fields), back.where("not is_whole").select("value")


# -- friend lists ----------------------------------------------------------


def _parsed_adjacency(lines: DataFrame) -> DataFrame:
    fields = F.split("value", "\t")
    body = F.regexp_replace(F.get(fields, F.lit(1)), r"^\{\(|\)\}$", "")
    entries = F.transform(F.split(body, ENTRY_BREAK), lambda e: F.split(e, ","))
    raw = F.transform(
        entries,
        lambda e: F.struct(
            F.get(e, F.lit(0)).try_cast("bigint").alias("friend_id"),
            F.get(e, F.lit(1)).try_cast("int").alias("mask"),
        ),
    )
    user = F.get(fields, F.lit(0)).try_cast("bigint")
    # Filters are not pushed below an explode, so each line is parsed once.
    once = F.explode(F.array(F.struct(user.alias("user_id"), raw.alias("raw"))))
    parsed = lines.select("value", once.alias("p")).select("value", "p.user_id", "p.raw")
    whole = F.forall(
        "raw", lambda f: f["friend_id"].isNotNull() & f["mask"].isNotNull()
    ) & F.col("user_id").isNotNull()
    return parsed.withColumn("is_whole", F.coalesce(whole, F.lit(False)))


def parse_adjacency(
    lines: DataFrame, on_bad: str = "fail", rejects: Observation | None = None
) -> DataFrame:
    """``user<TAB>{(id,mask),(id,mask)}`` lines to (user_id, friends), with the
    noise bit of every mask cleared."""
    return _clean_lists(_whole_lines(_parsed_adjacency(lines), on_bad, rejects))


def _clean_lists(whole: DataFrame) -> DataFrame:
    clean = f"named_struct('friend_id', f.friend_id, 'mask', {normalize('f.mask')})"
    return whole.selectExpr("user_id", f"transform(raw, f -> {clean}) AS friends")


def sorted_adjacency(lines: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``parse_adjacency`` makes of whole lines, and ``rejected_adjacency``, from one
    pass over ``lines``.  Both are stored, at ``path`` or in the shared folder."""
    whole, rejected = _both_kinds(_parsed_adjacency(lines), path)
    return _clean_lists(whole), rejected


def rejected_adjacency(lines: DataFrame) -> DataFrame:
    """The lines ``parse_adjacency`` cannot read."""
    return _parsed_adjacency(lines).where("not is_whole").select("value")


def read_adjacency(
    spark: SparkSession, path: str, on_bad: str = "fail", rejects: Observation | None = None
) -> DataFrame:
    return parse_adjacency(spark.read.text(path), on_bad, rejects)


# -- profiles --------------------------------------------------------------


def _parsed_profiles(lines: DataFrame) -> DataFrame:
    fields = F.split(F.rtrim(F.col("value"), F.lit("\t\r ")), "\t")
    columns = [
        _int_or_zero(fields, i, f.dataType.simpleString()).alias(f.name)
        for i, f in enumerate(PROFILES.fields)
    ]
    whole = F.lit(True)
    for f in PROFILES.fields:
        whole = whole & F.col(f.name).isNotNull()
    whole = whole & F.ltrim("value").rlike(r"^[^\t]")
    return lines.select("*", *columns).withColumn("is_whole", F.coalesce(whole, F.lit(False)))


def parse_profiles(
    lines: DataFrame, on_bad: str = "fail", rejects: Observation | None = None
) -> DataFrame:
    """Tab-separated profile lines; missing or empty fields are 0.

    Columns of ``lines`` other than ``value`` are kept, so that a line order
    can be carried along.
    """
    return _whole_lines(_parsed_profiles(lines), on_bad, rejects).drop("value", "is_whole")


def rejected_profiles(lines: DataFrame) -> DataFrame:
    """Blank lines, lines without a user id and lines with a field that is
    not a number."""
    return _parsed_profiles(lines).where("not is_whole").select("value")


def sorted_profiles(lines: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``parse_profiles`` makes of whole lines, and ``rejected_profiles``, from one pass
    over ``lines``.  Both are stored, at ``path`` or in the shared folder."""
    return _both_kinds(_parsed_profiles(lines), path)


def profile_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (``value``) with ``line_order``, which grows along each file.

    Blocks of one file may be read by different tasks, so the block's offset
    comes before the running number of the line within its task.
    """
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_order"),
    )


def read_profiles(
    spark: SparkSession, path: str, on_bad: str = "fail", rejects: Observation | None = None
) -> DataFrame:
    """Profiles with the ``line_order`` of ``profile_lines``."""
    return parse_profiles(profile_lines(spark, path), on_bad, rejects)


def latest_profiles(profiles: DataFrame, order: str | list[str]) -> DataFrame:
    """One row per user: the last by ``order``.  Reduced on the map side."""
    order = [order] if isinstance(order, str) else order
    rest = [c for c in profiles.columns if c != "user_id" and c not in order]
    last = profiles.groupBy("user_id").agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select("user_id", *[F.col("last")[c].alias(c) for c in rest])


# -- recommendations -------------------------------------------------------


def recommendation_lines(lists: DataFrame) -> DataFrame:
    """(user_id, friends) to (user_id, line) with tab-joined ids."""
    ids = F.concat_ws("\t", F.col("friends").cast("array<string>"))
    return lists.select(
        "user_id", F.concat_ws("\t", F.col("user_id").cast("string"), ids).alias("line")
    )


def write_recommendations(lists: DataFrame, path: str, single_file: bool = False) -> None:
    """Gzip text, sorted by user over all files; one file only on request."""
    lines = recommendation_lines(lists).orderBy("user_id").select("line")
    if single_file:
        lines = lines.coalesce(1)
    lines.write.option("compression", "gzip").text(path)
