"""Stacking columns into rows, the one reshaping that profiling and join discovery build on."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import stable_token

NESTED = (T.StructType, T.MapType, T.ArrayType, T.VariantType)
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
MOMENT = (T.DateType, T.TimestampType, T.TimestampNTZType)


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def col(name: str) -> Column:
    """Reference to a column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN turned into null, the one missing value, in floating-point columns."""
    types = field_types(df)
    floats = [c for c in (columns or df.columns) if isinstance(types.get(c), (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A DataFrame of schema-sized rows. Handed over as one Arrow batch it is a local relation: no task, no shuffle."""
    shape = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in shape.names]
    table = pa.table({n: pa.array(c, ARROW[f.dataType.simpleString()]) for n, c, f in zip(shape.names, columns, shape.fields)})
    return spark.createDataFrame(table, shape)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def melt_text(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``(column, value)`` rows of the chosen columns, values as comparable text. Nulls stay rows."""
    types = field_types(df)
    chosen = list(columns if columns is not None else df.columns)
    ready = df.select(*[col(k) for k in keep], *[stable_token(col(c), types[c]).alias(c) for c in chosen])
    return ready.unpivot([col(k) for k in keep], [col(c) for c in chosen], "column", "value")


def melt_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` rows with double values; NaN and infinities become null."""
    number = {c: F.when(~F.isnan(col(c).cast("double")) & (F.abs(col(c).cast("double")) != float("inf")),
                        col(c).cast("double")) for c in columns}
    return df.select(*[number[c].alias(c) for c in columns]).unpivot([], [col(c) for c in columns], "column", "value")


def value_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)``: how often each value occurs in each column.

    Equal values collapse on the map side, so a value holding a third of the rows costs one row per task.
    """
    return melt_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def digest_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(c, a, b, n)``: how often each value of each column occurs, where ``c`` is the column's place in ``columns``.

    A value travels as 16 bytes: a whole number as itself, anything else as two independent 64-bit hashes. Long text is never
    shuffled. Nulls and NaN are rows whose ``a`` is null.
    """
    types = field_types(df)

    def cell(i: int, name: str) -> Column:
        c, t = col(name), types[name]
        if isinstance(t, T.IntegralType):
            a, b = c.cast("bigint"), F.lit(0).cast("bigint")
        else:
            real = isinstance(t, (T.DoubleType, T.FloatType))
            v = F.nanvl(c.cast("double"), F.lit(None)) if real else c if isinstance(t, T.DecimalType) else stable_token(c, t)
            a, b = F.when(v.isNotNull(), F.xxhash64(v)), F.xxhash64(F.lit(1), v)
        return F.struct(F.lit(i).alias("c"), a.alias("a"), b.alias("b"))

    cells = F.array(*[cell(i, name) for i, name in enumerate(columns)])
    return df.select(F.inline(cells)).groupBy("c", "a", "b").agg(F.count(F.lit(1)).alias("n"))
