"""Readers for delimited text, JSON and Parquet, with load checks and integer narrowing."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.names import unique_names
from ..functions.text import NA_TOKENS, na_to_null, to_boolean, to_number
from ..operators.shape import col
from .lines import BAD_SCHEMA, LoadError, Loaded, file_lines, local_name, read_records


@dataclass(frozen=True)
class LoadReport:
    row_count: int
    col_count: int
    types: dict[str, str]
    warnings: list[str] = field(default_factory=list)
    bad_rows: int = 0


LOG = logging.getLogger("tabloom")
FILE = "_file_of_row"
BAD_ROW = "_malformed_row"


def _text_columns(spark: SparkSession, path: str | Sequence[str], names: list[str], options: dict) -> DataFrame:
    """Text columns by position, BAD_ROW with the raw text of rows that have more or fewer fields than the header, and the file."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD_ROW]])
    raw = spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW, **options)
    return raw.withColumn(FILE, F.col("_metadata.file_path"))


def _file_facts(spark: SparkSession, path: str | Sequence[str]) -> dict[str, tuple[bool, bool]]:
    """For each file, whether some line is no valid UTF-8, and whether some line has an odd number of quotes, as a quoted line
    break leaves. The driver holds file names."""
    line = F.col("line")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    found = file_lines(spark, path).groupBy("file").agg(F.bool_or(~F.is_valid_utf8(line)).alias("invalid"), F.bool_or(F.coalesce(odd, F.lit(False))).alias("broken"))
    return {local_name(r.file): (bool(r.invalid), bool(r.broken)) for r in found.collect()}


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type all their values fit: bigint, double, boolean, or text as it is.

    Missing-value words become null first. All rows decide, in one aggregate without a shuffle.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    clean = df.withColumns({c: na_to_null(col(c)) for c in texts})

    def every(test):
        return F.coalesce(F.bool_and(test), F.lit(True))

    checks = []
    for i, c in enumerate(texts):
        v = col(c)
        present = v.isNotNull()
        checks += [
            every(F.when(present, v.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(v).try_cast("bigint").isNotNull())).alias(f"i{i}"),
            every(F.when(present, to_number(v).isNotNull())).alias(f"d{i}"),
            every(F.when(present, F.lower(F.trim(v)).isin("true", "false"))).alias(f"b{i}"),
            F.count(v).alias(f"n{i}"),
        ]
    found = clean.agg(*checks).first()
    casts = {}
    for i, c in enumerate(texts):
        if not found[f"n{i}"]:
            continue
        if found[f"i{i}"]:
            casts[c] = F.trim(col(c)).try_cast("bigint")
        elif found[f"d{i}"]:
            casts[c] = to_number(col(c))
        elif found[f"b{i}"]:
            casts[c] = to_boolean(col(c))
    return clean.withColumns(casts) if casts else clean


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "UTF-8", multi_line: bool | None = None,
                   schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """As read_delimited_checked, without the rows that do not fit the header."""
    loaded = read_delimited_checked(spark, path, sep, encoding, multi_line, schema)
    return loaded.df, loaded.warnings


def read_delimited_checked(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "UTF-8", multi_line: bool | None = None,
    schema: T.StructType | None = None,
) -> Loaded:
    """Delimited text with a header row. Each file that is no valid UTF-8 is read as latin-1, the others as they are. Rows whose
    fields do not fit the header stay (missing fields are null, surplus ones are dropped), are counted and kept in ``bad``.

    ``schema`` gives the columns by position and saves the pass that looks for types; the checks are the same, and values that
    do not fit their type are null and counted. ``multi_line`` allows line breaks inside quotes and makes a file unsplittable;
    None looks for such breaks and reads only the files that have some in that way. With an encoding other than UTF-8 and
    ``multi_line`` given, the raw text is not looked at.
    """
    warnings: list[str] = []
    utf8 = encoding.upper().replace("-", "") == "UTF8"
    groups: dict[tuple[str, bool], list[str]] = {}
    if utf8 or multi_line is None:
        for file, (invalid, broken) in sorted(_file_facts(spark, path).items()):
            groups.setdefault(("ISO-8859-1" if utf8 and invalid else encoding, broken if multi_line is None else multi_line), []).append(file)
    if not groups:  # nothing to look at, or no line in any file
        groups = {(encoding, bool(multi_line)): []}
    latin = sum(len(files) for (e, _), files in groups.items() if utf8 and e != encoding)
    broken = sum(len(files) for (_, m), files in groups.items() if multi_line is None and m)
    if latin:
        warnings.append(f"not valid {encoding}; {latin} files decoded as latin-1 instead")
    if broken:
        warnings.append(f"quoted line breaks found; {broken} files are read whole")

    order = sorted(groups.items(), key=lambda g: (g[0][0] != encoding, g[0][1]))
    # one way for all: the path is read as given, with the columns that folder names give
    sources = [(path if len(order) == 1 else files, {"sep": sep, "header": True, "encoding": e, "quote": '"', "escape": '"', "multiLine": m, "enforceSchema": True}) for (e, m), files in order]
    header = spark.read.csv(sources[0][0], inferSchema=False, **sources[0][1]).columns
    folders = [f.name for f in spark.read.text(path).schema.fields if f.name != "value"] if len(order) == 1 else []
    header = [c for c in header if c not in folders]
    none = spark.createDataFrame([], BAD_SCHEMA)
    if not header:
        return Loaded(spark.read.csv(path, inferSchema=False, sep=sep, header=True), none, 0, warnings)
    names = unique_names([c if c else "unnamed" for c in header])
    df = _text_columns(spark, *sources[0][:1], names, sources[0][1])
    for files, options in sources[1:]:
        df = df.unionByName(_text_columns(spark, files, names, options))
    if schema is None:
        typed, misfit = infer_types(df.drop(BAD_ROW, FILE)), F.lit(False)
    else:
        if len(schema.fields) != len(names):
            warnings.append(f"the schema has {len(schema.fields)} columns, the header {len(names)}")
        casts, misfit = {}, F.lit(False)
        for name, f in zip(names, schema.fields):
            value = na_to_null(col(name))
            cast = value if isinstance(f.dataType, T.StringType) else to_boolean(value) if isinstance(f.dataType, T.BooleanType) else F.trim(value).try_cast(f.dataType)
            casts[f.name], misfit = cast, misfit | (value.isNotNull() & cast.isNull())
        missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields[len(names):]}
        typed = df.select(*[c.alias(n) for n, c in {**casts, **missing}.items()], *[col(c) for c in folders])
    # all columns are counted, for the reader finds a row malformed only where it parses the whole of it
    counts = df.agg(F.count_if(misfit).alias("misfit"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate([BAD_ROW, *names])]).first()
    if counts["n0"]:
        warnings.append(f"{counts['n0']} rows have more or fewer fields than the header")
    if counts["misfit"]:
        warnings.append(f"{counts['misfit']} rows have values that do not fit the schema")
    whole = F.length(F.concat_ws("", *[col(c) for c in names])) >= 0
    bad = df.where(F.col(BAD_ROW).isNotNull() & whole).select(F.col(FILE).alias("file"), F.col(BAD_ROW).alias("line"))
    return Loaded(typed, bad, counts["n0"], warnings)


def _told(loaded: Loaded, path: str | Sequence[str]) -> DataFrame:
    for warning in loaded.warnings:
        LOG.warning("%s: %s", path, warning)
    return loaded.df


def read_csv(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """Comma-separated text; warnings go to the log (read_delimited_checked returns them)."""
    return _told(read_delimited_checked(spark, path, ",", **options), path)


def read_tsv(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    return _told(read_delimited_checked(spark, path, "\t", **options), path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Records of JSON files, each file as lines or as one document; warnings go to the log (read_records returns them)."""
    return _told(read_records(spark, path, schema), path)


def read_json_checked(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """As read_json, with a warning that counts the lines which are no JSON records and are left out."""
    loaded = read_records(spark, path, schema)
    return loaded.df, loaded.warnings


def narrow_types(df: DataFrame) -> DataFrame:
    """Integers to the smallest of smallint, int, bigint that holds all their values."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))]
    if not whole:
        return df
    ends = df.agg(*[e for i, c in enumerate(whole) for e in (F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}"))]).first()
    casts = {}
    for i, c in enumerate(whole):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None:
            continue
        fits = lambda bits: -(2 ** (bits - 1)) <= lo and hi <= 2 ** (bits - 1) - 1
        casts[c] = col(c).cast("smallint" if fits(16) else "int" if fits(32) else "bigint")
    return df.withColumns(casts)


def check_loaded(df: DataFrame) -> DataFrame:
    """Raise when a table has no column or no row."""
    if not df.columns:
        raise LoadError("nothing that can be read as a table")
    if df.isEmpty():
        raise LoadError("the table has no rows")
    return df


FORMATS = {"csv": ",", "tsv": "\t"}


def load(spark: SparkSession, path: str, file_format: str | None = None, sep: str | None = None, encoding: str = "UTF-8",
         narrow: bool = True, multi_line: bool | None = None) -> tuple[DataFrame, LoadReport]:
    """Read any supported file and report rows, columns, types and warnings."""
    kind = (file_format or path.rsplit(".", 1)[-1]).lower()
    if kind in FORMATS:
        loaded = read_delimited_checked(spark, path, sep or FORMATS[kind], encoding, multi_line)
    elif kind == "parquet":
        loaded = Loaded(read_parquet(spark, path), spark.createDataFrame([], BAD_SCHEMA))
    elif kind in ("json", "jsonl", "ndjson"):
        loaded = read_records(spark, path)
    else:
        raise LoadError(f"Unsupported format: {kind}")
    df = narrow_types(loaded.df) if narrow and kind in FORMATS else loaded.df
    check_loaded(df)
    rows = df.count()
    return df, LoadReport(rows, len(df.columns), {f.name: f.dataType.simpleString() for f in df.schema.fields}, loaded.warnings, loaded.bad_rows)


def load_report(df: DataFrame) -> DataFrame:
    """The same figures as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("col_count"))


__all__ = [
    "LoadError", "LoadReport", "Loaded", "NA_TOKENS", "check_loaded", "infer_types", "load", "load_report", "narrow_types", "read_csv",
    "read_delimited", "read_delimited_checked", "read_json", "read_json_checked", "read_parquet", "read_records", "read_tsv",
]
