"""The corpus pipeline, stage by stage and as a whole."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkrec.llm import langid, mixing
from linkrec.storage import stored

SMALL = "/root/testdata/sf0.001"


def test_run_decides_as_brute_force_does(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language ID"](spark, docs, SMALL)
    texts = {r.doc_id: r.text for r in told.collect()}
    groups: dict = {}
    for k in sorted(texts, key=lambda k: (-len(texts[k]), k)):
        groups.setdefault("".join(texts[k].split()), k)
    unique = {r.doc_id for r in stages["exact dedup"](spark, told, SMALL).collect()}
    assert unique == set(groups.values())
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} <= unique and len({r.doc_id for r in out}) == len(out)
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert len(np.frombuffer(r.token_ids, "<u4")) == r.n_tokens


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_columns_and_bear_odd_rows(spark, at):
    text = "the quick brown fox jumps over the lazy dog again and again " * 9
    rows = [
        (1, text, "en", "a", 1, "x"),
        (1, text, "en", "a", 1, "x"),
        (2, text, "en", None, 1, "x"),
        (None, text + "end", None, "b", 1, None),
        (3, None, None, "b", None, "y"),
        (4, "", "fr", "b", None, "y"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars int, k string"
    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.createDataFrame(rows, schema)
    got = stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    if name == "exact dedup":
        assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3]
    if name == "n-gram Jaccard join":
        assert got.where(F.col("doc_id").isNull()).count() == 0
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_mixing_keeps_every_row_in_the_order_of_the_schedule(spark):
    sizes = {"hot": 900, "one": 1, None: 2, **{f"even{i}": 100 for i in range(9)}}
    names = [s for s, n in sizes.items() for _ in range(n)]
    rows = [(i, f"text {i}", s) for i, s in enumerate(names)]
    rows += [rows[5], rows[-1]]  # repeated rows stay as well
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["mixing sources"](spark, docs, SMALL).collect()]
    assert sorted(got) == sorted(rows)
    # While all of the large sources have rows left, each is near its share of them.
    counts = {s: names.count(s) + (s in ("hot", "even8")) for s in sizes if s not in ("one", None)}
    total = sum(n**mixing.ALPHA for n in counts.values())
    seen = dict.fromkeys(counts, 0)
    for _, _, s in got:
        if s not in seen:
            continue
        seen[s] += 1
        at = sum(seen.values())
        for own, n in counts.items():
            assert abs(seen[own] - at * n**mixing.ALPHA / total) < 3 * mixing.BLOCK
        if any(seen[own] == n for own, n in counts.items()):
            break
    assert at > 900


def test_encoded_rows_have_their_place_in_the_mix(spark):
    rows = [(i, f"text {i}", "ab"[i % 3 == 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing sources"](spark, docs, SMALL)
    order = [r.doc_id for r in mixed.collect()]
    got = stages["BPE encoding"](spark, stored(mixed, "mixed"), SMALL)
    places = {r.position: r.doc_id for r in got.collect()}
    assert [places[i] for i in range(600)] == order
    # Without the mix the places are others.
    plain = stages["BPE encoding"](spark, stored(docs, "plain"), SMALL)
    assert [r.doc_id for r in plain.orderBy("position").collect()] != order
    assert stages["BPE encoding"](spark, docs, SMALL).count() == 600


def test_rejected_texts_go(spark):
    docs = spark.createDataFrame([(1, "123 !!!"), (2, None)], "doc_id long, text string")
    assert langid.drop_rejected(docs, {"en": b"the of and", "fr": b"le la les"}).count() == 0
