"""Joins on a key whose rows may be very unevenly spread.

A hot key is one that holds more than 1/HOT_SHARE of all rows, so there can
never be more than HOT_SHARE of them and their list is safe to broadcast.  Rows
of a hot key are spread over as many salts as it has such shares, and the other
side's rows of that key are repeated once per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 10_000
# Keys with fewer rows than this are not worth splitting.
MIN_HOT_ROWS = 1_000_000


def hot_keys(
    counts: DataFrame, key: str, rows: str = "n_rows", total: int | None = None
) -> DataFrame | None:
    """(key, n_salts) for at most HOT_SHARE keys, from one row count per key.

    ``total`` is the number of all rows or more, where that is known: of a
    stored Parquet table the footers tell it.  If it shows that no key can be
    hot, the answer is None.  Otherwise the counts are summed in the plan.
    """
    if total is not None and total <= MIN_HOT_ROWS:
        return None
    all_rows = counts.agg(F.sum(rows)).scalar() if total is None else F.lit(total)
    limit = F.greatest(all_rows / HOT_SHARE, F.lit(float(MIN_HOT_ROWS)))
    hot = counts.withColumn("n_salts", F.ceil(F.col(rows) / limit).cast("int"))
    return hot.where("n_salts > 1").select(key, "n_salts")


def count_rows(df: DataFrame, key: str, rows: str = "n_rows") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(rows))


def salted_join(
    facts: DataFrame,
    other: DataFrame,
    on: list[str],
    hot: DataFrame | None,
    spread: list[str],
    how: str = "inner",
) -> DataFrame:
    """Join on ``on``, whose first column is the key that ``hot`` speaks of.

    ``spread`` names columns of ``facts`` that tell its rows of one key apart.
    """
    if hot is None:
        return facts.join(other, on, how)
    key = on[0]
    listed = F.broadcast(hot.toDF(key, "n_salts"))
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("n_salts", F.lit(1))).cast("int")
    left = facts.join(listed, key, "left").withColumn("salt", salt).drop("n_salts")
    salts = F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1)
    right = other.join(listed, key, "left").withColumn("salt", F.explode(salts)).drop("n_salts")
    return left.join(right, [*on, "salt"], how).drop("salt")
