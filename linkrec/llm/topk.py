"""Exact top-k by inner product: columnar branch-and-bound.

Vectors are whole numbers.  Candidates and queries are dealt into groups; each pair of
groups is a cell that one task works on.  In a cell the candidates lie dimension by
dimension.  For a query, scores grow one block of dimensions at a time; after each block
the product of what is left of both norms bounds what a candidate can still gain, and
candidates that cannot reach the k-th best known score are compacted away.  Vectors too
long for machine numbers are scored in Python's whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrec.llm.common import named, ship_package
from linkrec.storage import stored

DIMENSIONS = 16
CELL_BYTES = 16 << 20
# Below this bound on norms all sums are exact in floating point.
EXACT = float(1 << 52)
# Two vectors with norms below this have a score, and sums on the way to it, in a long.
LONG_NORM = float(1 << 31)
LONGS = range(-(1 << 63), 1 << 63)


def whole_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024
) -> DataFrame:
    """(vec_id, v, row_no): floor(scale * x) of each component, as longs.

    Left out are vectors that are null or hold a null or non-finite component, and rows
    with a null key.  A component beyond a long stops the job.  ``row_no`` tells rows apart
    that repeat a key; the table is stored, so that it stays the same.
    """
    limit, most = float("inf"), float(1 << 63)
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit))
    x = named(vector).cast("array<double>")
    rows = df.select(named(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    whole = lambda c: F.when(F.abs(c * scale) < most, F.floor(c * scale)).otherwise(
        F.raise_error("a component times the scale is no long").cast("long")
    )
    rows = rows.withColumn("row_no", F.monotonically_increasing_id())
    return stored(rows.select("vec_id", F.transform("x", whole).alias("v"), "row_no"), "vectors")


def _exact(query: np.ndarray, matrix: np.ndarray) -> list[int]:
    """Scores in whole numbers of any size."""
    own = query.tolist()
    return [sum(a * b for a, b in zip(own, row, strict=True)) for row in matrix.tolist()]


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))


class Columns:
    """Candidates dimension by dimension, with what is left of their norms."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, exact: bool):
        self.ids, self.rows = ids, rows
        self.columns = np.ascontiguousarray(matrix.T.astype(np.float64 if exact else np.int64))
        self.cuts = [*range(0, len(self.columns), DIMENSIONS), len(self.columns)]
        squares = matrix.astype(np.float64) ** 2
        self.rest = [np.sqrt(squares[:, cut:].sum(axis=1)) for cut in self.cuts]

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best but row ``own``, ties to the smaller key."""
        query = query.astype(self.columns.dtype)
        alive = np.flatnonzero(self.rows != own)
        rest = [math.sqrt(float((query[cut:].astype(np.float64) ** 2).sum())) for cut in self.cuts]
        score = np.zeros(len(alive), self.columns.dtype)
        floor = -np.inf
        for b, (a, z) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            part = self.columns[a:z] if len(alive) == len(self.ids) else self.columns[a:z, alive]
            score = score + query[a:z] @ part
            if len(alive) <= k or z == len(self.columns):
                continue
            if floor == -np.inf:  # complete the most promising ones for a first bound
                top = np.argpartition(-score, k - 1)[:k]
                full = score[top] + query[z:] @ self.columns[z:, alive[top]]
                floor = float(full.min())
            reach = score + rest[b + 1] * self.rest[b + 1][alive] * (1 + 1e-9) + 1
            slack = 1e-12 * (np.abs(score) + abs(floor))  # longs lose digits in doubles
            keep = reach + slack >= floor
            alive, score = alive[keep], score[keep]
        if len(alive) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[near], score[near]
        order = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][order], score[order].astype(np.int64)


def _matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows = table.column("vec_id").to_numpy(), table.column("row_no").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, rows, flat.reshape(len(ids), dims)


def _cell_best(candidates: pa.Table, asked: pa.Table, dims: int, k: int) -> list[tuple]:
    """(query row, query key, candidate key, score) of the k best in a cell, per query row.

    A score below all longs is None; one above them stops the job, as it is a best one.
    """
    ids, rows, matrix = _matrix(candidates, dims)
    query_ids, query_rows, queries = _matrix(asked, dims)
    norms, query_norms = _norms(matrix), _norms(queries)
    usual, plain = norms < LONG_NORM, query_norms < LONG_NORM
    most = lambda x: float(x.max(initial=0.0))
    columns = Columns(
        ids[usual],
        rows[usual],
        matrix[usual],
        most(norms[usual]) * most(query_norms[plain]) < EXACT,
    )
    found: list[tuple] = []
    for own, key, query, fits in zip(query_rows, query_ids, queries, plain, strict=True):
        best = [c.tolist() for c in columns.best(own, query, k)] if fits else [[], []]
        rest = np.flatnonzero((rows != own) & ~(usual & fits))
        each = [*zip(*best, strict=True), *zip(ids[rest].tolist(), _exact(query, matrix[rest]))]
        for vec_id, score in sorted(each, key=lambda e: (-e[1], e[0]))[:k]:
            if score > LONGS[-1]:
                raise OverflowError(f"the score of {key} and {vec_id} is no long")
            found.append((own, key, vec_id, score if score in LONGS else None))
    return found


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query.

    Both tables are (vec_id, v, row_no) as one call of ``whole_vectors`` makes them, or
    rows of it.  Only the query's own row is left out; ties go to the smaller key; fewer
    than k candidates are all returned.  Vectors meet only those of the same number of
    components.  Repeated rows and keys are candidates, and queries, of their own.  Vectors
    of any length take part; a score to be returned that is no long stops the job.  Every
    candidate is compared with every query, cell by cell; a cell holds about ``cell_bytes``
    of either.
    """
    ship_package(vectors.sparkSession)
    sized = vectors.withColumn("dims", F.size("v"))
    asked = queries.withColumn("dims", F.size("v"))
    volume = lambda d: d.agg(F.coalesce(F.sum(8 * F.col("dims") + 16), F.lit(0))).first()[0]
    groups = max(1, -(-volume(sized) // cell_bytes))
    sets = max(1, -(-volume(asked) // cell_bytes))
    dealt = lambda n: F.pmod(F.xxhash64("row_no"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sized.withColumn("g", dealt(groups)).withColumn("h", every(sets))
    right = asked.withColumn("h", dealt(sets)).withColumn("g", every(groups))
    names = ["query_no", "query_id", "vec_id", "score"]
    out = pa.schema([(name, pa.int64()) for name in names])

    def cell(key: tuple, candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asked.num_rows:
            return out.empty_table()
        found = _cell_best(candidates, asked, key[0].as_py(), k)
        columns = zip(*found, strict=True) if found else [()] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=out)

    keys = ["dims", "g", "h"]
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        cell, "query_no long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_no").orderBy(F.desc_nulls_last("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.coalesce("score", F.raise_error("a score is no long").cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
