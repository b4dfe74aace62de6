"""Helpers shared by the operators: whole rows in and out of Arrow tasks, and keys for rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import cut_lineage

PIECE_CHARS = 4_000_000
PIECE_ROWS = 2_000


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator's tasks keep in a Python worker from one task to the next."""
    return _KEPT.setdefault(owner, {})


def drop_kept(owner: str | None) -> None:
    """A worker keeps things of one operator at a time: a task of another one frees their memory."""
    for other in [o for o in _KEPT if o != owner]:
        del _KEPT[other]


def map_rows(df: DataFrame, schema: str, fn: Callable[..., tuple], keeps: str | None = None) -> DataFrame:
    """``fn(*values of a row) -> tuple`` for every row, in Arrow tasks. Results leave in pieces bounded by size, so a task
    never holds more than one piece and one incoming batch (which Spark bounds by bytes)."""
    return map_batches(df, schema, lambda rows: (fn(*r) for r in rows), keeps)


def map_batches(df: DataFrame, schema: str, fn: Callable[[Iterator[tuple]], Iterator[tuple]], keeps: str | None = None) -> DataFrame:
    """As map_rows, for a generator over all rows of a task. ``keeps`` names the operator whose kept things the tasks use."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        held, size = [], 0
        for row in fn(rows_of(batches)):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
            if len(held) >= PIECE_ROWS or size >= PIECE_CHARS:
                yield to_batch(held, arrow)
                held, size = [], 0
        if held:
            yield to_batch(held, arrow)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def sql_type(df: DataFrame, column: str) -> str:
    """The type of a column in DDL, to carry a column through a task unchanged."""
    return df.schema[column].dataType.simpleString()


def text_key(value: str | Column) -> Column:
    """A text that is never null and differs for null and every value, to join rows on columns that may be null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def least_hashed(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the least hash of the columns ``by``. The hashes alone are ordered, each task keeping n of them; whole
    rows are read again by the greatest hash that is in."""
    code = F.xxhash64(*by)
    most = df.select(code.alias("code")).orderBy("code").limit(n).agg(F.max("code")).first()[0]
    return df.where(code <= F.lit(most)).limit(n)


__all__ = ["cut_lineage", "kept", "least_hashed", "map_batches", "map_rows", "sql_type", "text_key", "to_batch"]
