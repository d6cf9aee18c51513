"""Graph and profile views over the supplied test tables (FIXTURES.md).

Each line item becomes one listed friend of the customer who ordered it, by
row-wise arithmetic, so the views grow in step with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrec.functions.relations import normalize

# Adjacency lines are cut every so many friend ids, so that no line can hold
# more entries than this.
LINE_WIDTH = 1000


def _utc_millis(column: str) -> str:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return f"""(unix_date(date({column})) * 86400000L + hour({column}) * 3600000
        + minute({column}) * 60000 + bigint(extract(SECOND FROM {column}) * 1000))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Who a line item stands for: mostly people of the customer's own block.
FRIEND = """CASE WHEN l_partkey % 23 = 0 THEN l_suppkey % 4
                 WHEN l_partkey % 3 = 0 THEN (o_custkey div 10) * 10 + l_partkey % 12
                 ELSE (o_custkey div 40) * 40 + l_partkey % 60 END"""
# One of 200 people that everybody lists some of, so that all groups grow with the data.
STAR = "10000000 + l_partkey % 200"
# The same with a few who are listed far more often than the others.
FAME = "20000000 + (l_partkey % 1000) * (l_partkey % 1000) * (l_partkey % 1000) div 5000000"


def raw_edges(spark: SparkSession, sf_dir: str, who: str = FRIEND) -> DataFrame:
    """edges(user_id, friend_id, raw_mask), one row per listed friend."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    listed = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("user_id"), F.expr(who).alias("friend_id"))
        .where("user_id <> friend_id")
        .distinct()
    )
    mask = F.expr(
        """CASE WHEN (user_id * 13 + friend_id * 29) % 24 < 4 THEN 0
                ELSE shiftleft(1, cast((user_id * 13 + friend_id * 29) % 24 - 3 as int)) END
           | CASE WHEN (user_id + friend_id) % 5 = 0 THEN 256 ELSE 0 END
           | CASE WHEN (user_id div 40) % 7 = 3 THEN 1024 ELSE 0 END
           | cast((user_id + friend_id) % 2 as int)"""
    )
    return listed.withColumn("raw_mask", mask)


def edges(spark: SparkSession, sf_dir: str, who: str = FRIEND) -> DataFrame:
    """edges(user_id, friend_id, mask) with the noise bit cleared."""
    raw = raw_edges(spark, sf_dir, who)
    return raw.selectExpr("user_id", "friend_id", f"{normalize('raw_mask')} AS mask")


def adjacency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw edges as adjacency lines (column ``value``)."""
    entry = F.format_string("(%d,%d)", "friend_id", "raw_mask")
    lists = (
        raw_edges(spark, sf_dir)
        .groupBy("user_id", F.expr(f"friend_id div {LINE_WIDTH}").alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    return lists.select(
        F.concat(
            F.col("user_id").cast("string"),
            F.lit("\t{"),
            F.concat_ws(",", "entries"),
            F.lit("}"),
        ).alias("value")
    )


def some_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles without those of ``user_id % 13 = 5``, to meet the defaults of missing ones."""
    return all_profiles(spark, sf_dir).where("user_id % 13 <> 5")


def all_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all customers."""
    first_order = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.min("o_orderdate").alias("first_date"))
    )
    people = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .withColumnRenamed("c_custkey", "user_id")
    )
    return people.join(first_order, "user_id", "left").select(
        "user_id",
        F.expr(f"coalesce({_utc_millis('first_date')}, 0) AS create_ms"),
        F.col("c_acctbal").cast("int").alias("age_days"),
        F.expr("cast(user_id % 3 as int)").alias("sex"),
        F.col("c_nationkey").cast("bigint").alias("country"),
        F.col("n_regionkey").cast("bigint").alias("location"),
        F.expr("user_id % 5").alias("login_region"),
    )


def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles as tab-separated lines; zeros are left empty."""
    fields = [
        F.when(F.col(c) == 0, F.lit("")).otherwise(F.col(c).cast("string"))
        for c in ["create_ms", "age_days", "sex", "country", "location", "login_region"]
    ]
    line = F.concat_ws("\t", F.col("user_id").cast("string"), *fields)
    return all_profiles(spark, sf_dir).select(F.rtrim(line, F.lit("\t")).alias("value"))


def profile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile row per order of a customer, with its order in time."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"
    )
    return orders.join(people, F.expr("o_custkey = c_custkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.expr(f"{_utc_millis('o_orderdate')} AS create_ms"),
        F.expr("cast(o_orderkey % 20000 as int)").alias("age_days"),
        F.expr("cast(o_orderkey % 3 as int)").alias("sex"),
        F.col("c_nationkey").cast("bigint").alias("country"),
        F.expr("o_orderkey % 7").alias("location"),
        F.expr("o_orderkey % 5").alias("login_region"),
        "o_orderdate",
        "o_orderkey",
    )
