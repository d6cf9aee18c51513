"""Importance resampling next to a plain version, and the exact selection by itself."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from check_oracles import differences
from pyspark.sql import functions as F

from linkrec.llm import catalog, resample

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, rank int"
TEXT = "The quick brown Fox, jumps over the lazy dog; again and again until 10 o'clock "


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    both = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in both]


def brute(docs, target, percent=25, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    found = [features(text or "") for _, text in docs]
    for counts, lists in ((s, [f for _, f in found]), (t, [features(x or "")[1] for x in target])):
        for each in lists:
            for b in each:
                counts[b] += 1
    gain = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000))))
        for a, b in zip(s, t)
    ]
    out = []
    for (key, _), (n, own) in zip(docs, found):
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        text = f"7:{'' if key is None else key}"
        h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(own), weight, weight + noise, None, n])
    fit = [r for r in out if r[5] >= least]
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for at, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = at
    return [tuple(r[:5]) for r in out]


def got(df):
    rows = df.select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    df = catalog.op13_resample(spark, SMALL)
    assert got(df) == sorted(brute([tuple(r) for r in docs], target), key=repr)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = db.sql(catalog.ORACLES["op13_resample"])
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert differences(df.toPandas(), rel.df(), dict(df.dtypes), types) == []


@pytest.mark.parametrize("percent", [0, 25, 50, 100])
def test_odd_rows(spark, percent):
    rows = [(k, TEXT * (1 + k % 3) + str(k), "x", 1) for k in range(40)]
    rows += [(7, rows[7][1], "x", 1)] * 9  # repeated rows tie
    rows += [(None, TEXT * 2, None, None), (None, None, None, 1), (50, "", "y", 1), (51, " ;\n", "y", 1)]
    rows += [(52, "é日本 Ünï " * 30, "y", 1), (53, "w" * 3_000_000 + " tail", "y", 1)]
    rows += [(54, "one word after the other " * 90_000, "y", 1)]  # several parts
    target = [(1, TEXT, "", 0), (2, None, "", 0), (3, "clock", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    of = spark.createDataFrame(target, SCHEMA)
    drawn = resample.importance_resample(df, of, percent)
    want = brute([r[:2] for r in rows], [t[1] for t in target], percent)
    assert got(drawn) == sorted(want, key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, TEXT * 3, "", 0)], SCHEMA)
    assert got(resample.importance_resample(none, some)) == []
    want = brute([(1, TEXT * 3)], [], 100)
    assert got(resample.importance_resample(some, none, 100)) == want


def test_pairs_go_over_parts(monkeypatch):
    text = "Alpha beta, gamma  delta e f g " * 20
    whole = features(text)
    for size in (1, 7, 16, 1000):
        monkeypatch.setattr(resample, "CHUNK", size)
        parts = list(resample.feature_buckets(text))
        assert sum(n for n, _ in parts) == whole[0]
        assert sorted(b for _, f in parts for b in f.tolist()) == sorted(whole[1])


@pytest.mark.parametrize("wanted", [1, 2, 77, 500, 999, 1000])
def test_cutoff_is_exact(spark, monkeypatch, wanted):
    monkeypatch.setattr(resample, "FEW", 3)
    rng = random.Random(5)
    # Few values of the first part, so that the others have to decide.
    rows = [(rng.choice([3, 3, 3, -9, 1 << 40]), rng.randrange(20), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, row long").repartition(7)
    assert resample.cutoff(df, 1000, wanted) == sorted(rows)[wanted - 1]
    assert resample.cutoff(df, 1000, 0) is None


def test_places_are_those_of_the_sorted_rows(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("x"))
    rows = resample.numbered(df.repartition(5), ["x"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 5_001))
    assert [r.x for r in rows] == sorted(r.x for r in rows)
