"""Whitening next to a dense eigensolver, and edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from linkrec.llm import catalog, whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def brute(rows, scale=64, k=16, offset=1_000_000):
    """Rows (vec_id, component, n, deviation, |whitened|, explained) by dense linear algebra."""
    fine = [
        (key, [math.floor(scale * c) + offset for c in x])
        for key, x in rows
        if x and all(c is not None and math.isfinite(c) for c in x)
    ]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = (centred**2).sum() / n
    out = []
    for key, x in fine:
        far = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for j in range(len(values)):
            if values[j] > 1e-9 * values[0]:
                told = abs(far @ vectors[:, j]) / math.sqrt(values[j])
                out.append((key, j + 1, n, deviation, told, values[j] / total))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = sorted([(*r[:4], abs(r[4]), r[5]) for r in got], key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-8, atol=1e-9)


def told(df):
    return [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in df.collect()]


def test_query_equals_dense_eigensolver(spark):
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    df = catalog.op11_whitening(spark, SMALL)
    compare(told(df), brute([tuple(r) for r in given]))
    assert dict(df.dtypes)["deviation"] == "bigint"
    errors = {r.identity_error for r in df.select("identity_error").distinct().collect()}
    assert len(errors) == 1 and errors.pop() <= 1e-9


@pytest.mark.parametrize("name", ["falling", "flat", "clusters", "tight pair"])
def test_spectra(spark, name):
    rng = np.random.default_rng(2)
    spread = {
        "falling": 0.8 ** np.arange(60) * 40,
        "flat": np.ones(60),
        "clusters": np.repeat([9.0, 3.0, 1.0], 20),
        "tight pair": np.concatenate([[5.0, 4.999], np.linspace(2, 1, 58)]),
    }[name]
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    x = (rng.standard_normal((3_000, 60)) * spread) @ turn
    rows = [(i, v.tolist(), "", "") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = whitening.whiten(df)
    want = brute([r[:2] for r in rows])
    got = told(out)
    assert [r[:4] for r in sorted(got)] == [r[:4] for r in sorted(want)]
    # Signs are free, and so are turns among values that are nearly equal; explained is not.
    np.testing.assert_allclose(
        [r[5] for r in sorted(got)], [r[5] for r in sorted(want)], rtol=1e-10
    )
    compare(got, [(*w[:4], w[4], w[5]) for w in want])
    assert out.first().identity_error < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(30)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1])]  # repeated rows and vectors
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # one vector is in half of all rows
    odd = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [float("nan")] * 5)]
    odd += [(94, [float("inf")] + [0.0] * 4), (95, [1.0, 2.0]), (96, [-0.0] * 5)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], SCHEMA).repartition(4)
    compare(told(whitening.whiten(df)), brute(rows + [(96, [-0.0] * 5)]))


def test_few_directions(spark):
    rows = [(i, [float(i % 7), float(i % 7) * 2, 3.0]) for i in range(20)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = told(whitening.whiten(df))
    compare(got, brute(rows))
    assert {r[1] for r in got} == {1}
    same = spark.createDataFrame([(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")], SCHEMA)
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(same.limit(0)).collect() == []
    assert whitening.whiten(same).columns == whitening.whiten(df).columns


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(3**i % 1000 * 2**35), float(i)]) for i in range(12)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    sums = told(whitening.whiten(df, components=1))
    want = {r[0]: r[3] for r in brute(rows)}
    assert {r[0]: r[3] for r in sums} == want and max(want.values()) > 1 << 63
    huge = spark.createDataFrame([(1, [1e300], "", ""), (2, [1.0], "", "")], SCHEMA)
    with pytest.raises(Exception, match="too large to become a long"):
        whitening.whiten(huge).collect()


def test_partial_results_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 64)
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(4).tolist(), "", "") for i in range(200)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(9)
        compare(told(whitening.whiten(df)), brute([r[:2] for r in rows]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
