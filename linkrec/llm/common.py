"""Small helpers of the text operators.

Every operator takes the names of its key and text columns, looks at no other
column, and returns the key as ``doc_id`` with columns of its own.  So extra or
clashing columns of the input never matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linkrec.shipping import ship_package

def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of ``df``, with null texts as empty ones."""
    return df.select(
        named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text")
    )


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; null keys never do."""
    rest = F.crc32(F.encode(key.cast("string"), "UTF-8")) % modulus
    return F.coalesce(rest == remainder, F.lit(False))


def arrow_map(
    df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str, batch: int = 1024
) -> DataFrame:
    """mapInArrow for a generator of dicts; at most ``batch`` rows are held each way."""
    ship_package(df.sparkSession)
    probe = df.sparkSession.createDataFrame([], schema)
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in probe.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def single() -> Iterator[dict]:
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    yield from b.slice(at, batch).to_pylist()

        out: list[dict] = []
        size = 0
        for row in rows(single()):
            out.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, bytes | str))
            if len(out) >= batch or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from one aggregate."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
