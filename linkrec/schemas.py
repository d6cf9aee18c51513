"""Explicit schemas of the data the toolkit reads and writes."""

from pyspark.sql import types as T

FRIEND = T.StructType(
    [T.StructField("friend_id", T.LongType()), T.StructField("mask", T.IntegerType())]
)
ADJACENCY = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("friends", T.ArrayType(FRIEND))]
)
EDGES = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("friend_id", T.LongType()),
        T.StructField("mask", T.IntegerType()),
    ]
)
MEMBER = T.StructType(
    [T.StructField("member_id", T.LongType()), T.StructField("mask", T.IntegerType())]
)
GROUPS = T.StructType(
    [
        T.StructField("mid_id", T.LongType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("degree", T.LongType()),
        T.StructField("members", T.ArrayType(MEMBER)),
    ]
)
# Profile fields in file order.
PROFILES = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("create_ms", T.LongType()),
        T.StructField("age_days", T.IntegerType()),
        T.StructField("sex", T.IntegerType()),
        T.StructField("country", T.LongType()),
        T.StructField("location", T.LongType()),
        T.StructField("login_region", T.LongType()),
    ]
)
PROFILE_FIELDS = [f.name for f in PROFILES.fields if f.name != "user_id"]
