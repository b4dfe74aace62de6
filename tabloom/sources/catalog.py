"""A directory of files as named tables plus a catalog of what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import find_table, find_tables_by_prefix, table_names
from .readers import read_delimited_checked, read_records

CATALOG_SCHEMA = "table string, path string, rows bigint, columns int, size_mb double, status string, bad_rows bigint, warnings array<string>"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size_mb)`` of every CSV and JSON file below ``root``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where(F.lower("path").rlike(r"\.(csv|json)$")).select("path", (F.col("length") / (1024.0 * 1024.0)).alias("size_mb"))


def scan_tables(spark: SparkSession, root: str, max_file_mb: float | None = None, multi_line: bool | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Named tables of a directory, and a catalog ordered by status, then rows (largest first, unknown last).

    The driver holds file names only. A file that cannot be read becomes a catalog row, not a failure.
    """
    base = root.rstrip("/") + "/"
    found = sorted(list_files(spark, root).collect(), key=lambda r: r.path)
    relative = [r.path.split(base, 1)[-1] for r in found]
    tables: dict[str, DataFrame] = {}
    rows = []
    for name, rel, file in zip(table_names(relative), relative, found):
        size = round(file.size_mb, 2)
        if max_file_mb is not None and file.size_mb > max_file_mb:
            rows.append((name, rel, None, None, size, f"skipped_size_gt_{max_file_mb}MB", None, None))
            continue
        try:
            loaded = read_delimited_checked(spark, file.path, multi_line=multi_line) if rel.lower().endswith(".csv") else read_records(spark, file.path)
            count = loaded.df.count()
        except Exception as problem:  # a broken file must not hide the others
            rows.append((name, rel, None, None, size, f"error:{type(problem).__name__}", None, None))
            continue
        tables[name] = loaded.df
        rows.append((name, rel, count, len(loaded.df.columns), size, "loaded", loaded.bad_rows, loaded.warnings))
    catalog = spark.createDataFrame(rows, CATALOG_SCHEMA)
    return tables, catalog.orderBy(F.col("status").asc(), F.col("rows").desc_nulls_last(), "table")


__all__ = ["CATALOG_SCHEMA", "find_table", "find_tables_by_prefix", "list_files", "scan_tables"]
