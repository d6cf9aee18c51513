"""Queries that apply the text operators to the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrec.llm import (
    bpe,
    class_lm,
    common,
    exact_dedup,
    jaccard,
    langid,
    licenses,
    mixing,
    pfp,
    rank_bpe,
    resample,
    token_files,
    topk,
    whitening,
)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    return import_module("public_tokenizers").path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    decoded = bpe.encode(documents(spark, sf_dir), path, decoded=True)
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("token_ids") / 4).alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    files = token_files.write_tokens(documents(spark, sf_dir), path, end_id=2)
    return token_files.read_tokens(files).select(
        "doc_id",
        "start",
        F.floor(F.octet_length("token_ids") / 4).alias("n_tokens"),
        F.crc32("token_ids").alias("ids_crc32"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = common.held_out(F.col("doc_id"), 5, 1)
    return class_lm.score_texts(documents(spark, sf_dir), held)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = topk.whole_vectors(table)
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op6_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.drop_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = common.held_out(F.col("doc_id"), 4, 2)
    dictionaries = langid.fit_dictionaries(docs.where(~out))
    found = langid.identify(docs, dictionaries)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(table).withColumn("deviation", F.col("deviation").cast("long"))


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    pattern = import_module("public_tokenizers").PATTERN
    encoded = rank_bpe.encode(documents(spark, sf_dir), path, pattern, decoded=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = resample.importance_resample(documents(spark, sf_dir), target)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_token_files,
        op3_exact_dedup,
        op4_class_lm,
        op5_topk,
        op6_pfp_dedup,
        op7_langid,
        op8_jaccard,
        op9_mixing,
        op10_licenses,
        op11_whitening,
        op12_rank_bpe,
        op13_resample,
    )
}

_TOP = """
WITH x AS (
  SELECT vec_id, row_number() OVER () AS row_no,
    list_transform(embedding, lambda c: floor(1024 * c::double)::hugeint) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.row_no, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM x q JOIN x c ON q.vec_id % 100 = 0 AND c.row_no <> q.row_no AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id)::int AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score::bigint AS score FROM r WHERE rank <= 10
"""

_EXACT = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
  FROM documents
), g AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY k) AS group_size,
    first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""

_RESAMPLE = r"""
WITH table_of AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), word_lists AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text
  FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), w AS (
  SELECT side, row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM word_lists
), f AS (
  SELECT side, row, f, count(*) AS n FROM (
    SELECT side, row, unnest(
      ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f
    FROM w)
  GROUP BY ALL
), crc AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(range(1, length(h), 2), lambda i:
      16 * instr('0123456789ABCDEF', substr(h, i, 1)) - 17
        + instr('0123456789ABCDEF', substr(h, i + 1, 1)))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)), table_of
), by_bucket AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t
  FROM f JOIN crc USING (f) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM by_bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(
    ((coalesce(t, 0) + 1) * (s_all + 10000))::double
      / ((coalesce(s, 0) + 1) * (t_all + 10000))::double
  ))::bigint AS gain
  FROM by_bucket, totals
), sums AS (
  SELECT row, sum(n)::bigint AS n_features, floor(sum(n * gain) / sum(n)::double)::bigint AS weight
  FROM f JOIN crc USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(
      list_prepend(0, list_transform(range(1, 9), lambda i: instr('0123456789abcdef',
        substr(sha256('7:' || coalesce(doc_id::varchar, '')), i, 1)) - 1)),
      lambda a, x: 16 * a + x) + 0.5)::double / 4294967296)))::bigint AS score
  FROM w LEFT JOIN sums USING (row) WHERE side = 'd'
), ranked AS (
  SELECT *, count(*) FILTER (n_words >= 20) OVER () AS n, row_number() OVER (
    PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank
FROM ranked
"""

ORACLES = {"op3_exact_dedup": _EXACT, "op5_topk": _TOP, "op13_resample": _RESAMPLE}
