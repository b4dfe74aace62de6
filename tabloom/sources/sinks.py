"""Writers: Parquet and CSV results, append-only run logs."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.shape import NESTED, col

# Log columns and allowed severities.
LOG_SCHEMA = (
    "job_id string, step_name string, action string, column_name string, before_value string, after_value string, "
    "reason string, severity string"
)
SEVERITIES = ("info", "warning", "error")
MERGE_SCHEMA = (
    "left_col string, right_col string, strategy string, join_type string, merged_rows bigint, matched_rows bigint, "
    "left_only_rows bigint, right_only_rows bigint, warnings array<string>"
)


def to_storable(df: DataFrame) -> DataFrame:
    """Every column as a plain storable type: nested values as JSON text, bytes as text; real timestamps untouched."""
    def plain(f: T.StructField):
        if isinstance(f.dataType, NESTED):
            return F.to_json(col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.BinaryType):
            # decode raises on malformed bytes; make_valid replaces them
            return F.make_valid_utf8(col(f.name).cast("string")).alias(f.name)
        return col(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_storable(df).write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """Header row, no row index, quotes doubled inside quoted text."""
    writer = to_storable(df).write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    writer.csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue="")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def log_frame(spark: SparkSession, entries: Iterable[Mapping]) -> DataFrame:
    """Log entries (schema-sized: a few per column) as a DataFrame with the fixed log columns."""
    rows = []
    for e in entries:
        severity = e.get("severity", "info")
        if severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}")
        text = lambda v: None if v is None else json.dumps(v, default=str, sort_keys=True)
        rows.append((e.get("job_id"), e["step_name"], e["action"], e.get("column_name"), text(e.get("before_value")),
                     text(e.get("after_value")), e.get("reason"), severity))
    return spark.createDataFrame(rows, LOG_SCHEMA)


def append_log(logs: DataFrame, path: str) -> None:
    logs.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def merge_record(stats: DataFrame, left_col: str, right_col: str, strategy: str, join_type: str, warnings: DataFrame) -> DataFrame:
    """One merge-history row from the match statistics and warnings of a join (at most five warnings)."""
    texts = warnings.agg(F.sort_array(F.collect_list("warning")).alias("w")).scalar()
    counts = [F.col(c).cast("bigint").alias(c) for c in ("merged_rows", "matched_rows", "left_only_rows", "right_only_rows")]
    return stats.select(F.lit(left_col).alias("left_col"), F.lit(right_col).alias("right_col"), F.lit(strategy).alias("strategy"),
                        F.lit(join_type).alias("join_type"), *counts, texts.alias("warnings"))


def append_merge(record: DataFrame, path: str) -> None:
    record.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def history_page(history: DataFrame, limit: int = 20, offset: int = 0, newest: str = "created_at", tie: str | None = None) -> DataFrame:
    """A page of a history table, newest first."""
    order = [F.col(newest).desc()] + ([F.col(tie)] if tie else [])
    return history.orderBy(*order).offset(offset).limit(limit)
