from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import brute
from linkrec.functions import relations as rel

masks = st.integers(0, 2**21 - 1)
few = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first()["v"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bit_0_is_removed(spark):
    assert value(spark, rel.normalize("17")) == 16
    assert value(spark, rel.normalize("16")) == 16


def test_inversion(spark):
    cases = {2048: 64, 2049: 65, 2050: 66, 8: 8, 16: 8, 4096: 8192, 8192: 8192, 24: 8}
    for mask, inverted in cases.items():
        assert value(spark, rel.invert(str(mask))) == inverted


def test_swap_exchanges_directions(spark):
    for a, b in rel.DIRECTED:
        a, b = rel.MASKS[a], rel.MASKS[b]
        assert value(spark, rel.invert(str(a), "swap")) == b
        assert value(spark, rel.invert(str(b), "swap")) == a
        assert value(spark, rel.invert(str(a | b | 2), "swap")) == a | b | 2


def test_combine_golden_rows(spark):
    assert value(spark, rel.combine("4", "8")) == rel.BUCKETS["CLOSE_FAMILY"]
    assert value(spark, rel.combine("4", "32768")) == 0
    assert value(spark, rel.combine("0", "8")) == 0
    assert value(spark, rel.combine("0", "0")) == 0
    assert value(spark, rel.combine("256", "256")) == rel.BUCKETS["CLOSE_FRIENDS"]


def test_typed_weight_of_two_relatives(spark):
    assert value(spark, rel.typed_weight(rel.combine("64", "64"))) == 2.0
    assert value(spark, rel.edge_weight("1")) == 1.0


def test_counter_of_a_family_pair(spark):
    packed = rel.bucket_counter(rel.combine("8", "262144"))
    assert value(spark, rel.read_counter(packed, "FAMILY")) == 1
    assert value(spark, rel.read_counter(packed, "ARMY")) == 0


def test_merged_counters_add_up_and_stop_at_7(spark):
    total = "0"
    for m1, m2 in [(8, 262144), (2, 256), (512, 512), (256, 256)]:
        bucket = value(spark, rel.combine(str(m1), str(m2)))
        total = str(value(spark, rel.merge_counters(total, rel.bucket_counter(str(bucket)))))
    assert value(spark, rel.read_counter(total, "FAMILY")) == 1
    assert value(spark, rel.read_counter(total, "CLOSE_FRIENDS")) == 2
    assert value(spark, rel.read_counter(total, "WORK")) == 1
    for _ in range(9):
        total = str(value(spark, rel.merge_counters(total, rel.bucket_counter("1"))))
    assert value(spark, rel.read_counter(total, "FAMILY")) == 7
    assert value(spark, rel.read_counter(total, "WORK")) == 1


def test_source_masks():
    assert rel.FULL_SOURCES["CLOSE_FAMILY"] == 316
    assert rel.MAIN_SOURCES["CLOSE_FAMILY"] == 60
    assert rel.FULL_SOURCES["FAMILY"] == 997628
    assert rel.MAIN_SOURCES["FAMILY"] == 997568
    assert rel.FULL_SOURCES["CLOSE_FRIENDS"] == 270


@few
@given(st.lists(st.tuples(masks, masks), min_size=1, max_size=300))
def test_combine_equals_brute_force(spark, rows):
    rows = [(m & ~1, n & ~1) for m, n in rows] + [(m & ~1, m & ~1) for m, _ in rows]
    df = table(spark, rows, "m int, n int").selectExpr(
        "m",
        "n",
        f"{rel.combine('m', 'n')} AS bucket",
        f"{rel.combine('n', 'm')} AS swapped",
        f"{rel.max_edge_weight(rel.full_buckets('m'), 'typed')} AS most",
        f"{rel.typed_weight(rel.combine('m', 'n'))} AS weight",
    )
    for r in df.collect():
        assert r["bucket"] == r["swapped"] == brute.code(brute.combine(r["m"], r["n"]))
        assert r["weight"] <= r["most"]


@few
@given(st.lists(masks, min_size=1, max_size=300))
def test_canonical_inversion_is_idempotent(spark, rows):
    once, twice = rel.invert("m"), rel.invert("n")
    df = table(spark, [(m,) for m in rows], "m int").selectExpr("m", f"{once} AS n")
    swapped = rel.invert(rel.invert("m", "swap"), "swap")
    for r in df.selectExpr("m", "n", f"{twice} AS n2", f"{swapped} AS back").collect():
        assert r["n"] == r["n2"]
        assert r["m"] == r["back"]


@few
@given(st.lists(st.tuples(*[st.integers(0, 2**24 - 1)] * 3), min_size=1, max_size=100))
def test_counters_merge_in_any_order(spark, rows):
    df = table(spark, rows, "a int, b int, c int").selectExpr(
        "a", "b", "c", f"{rel.merge_counters('a', 'b')} AS ab", f"{rel.merge_counters('b', 'c')} AS bc"
    )
    df = df.selectExpr(
        f"{rel.merge_counters('ab', 'c')} AS left", f"{rel.merge_counters('a', 'bc')} AS right"
    )
    assert all(r["left"] == r["right"] for r in df.collect())
