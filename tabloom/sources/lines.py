"""JSON records from lines and documents, decided per file by a proof of where its records end.

A JSON string cannot hold a raw line break, so every line can be read outside strings on its own: what it opens less what it
closes is known without its neighbours. A file is one document over several lines where its first line leaves a bracket open,
all brackets are closed in the end, and every line break between lies inside brackets; everything else is lines, one record each.
A truncated line opens a bracket that nothing closes, and so never turns a file of records into a document.

Depths are prefix sums: inside a block of a file (a split, so bounded) by a window over integers, across blocks by one row per
block. Files whose first line is closed, as all of a normal load are, never get that far: they are told by one aggregate.
Lines that are no record are a table of their own, beside the records, and are counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shape import col

MALFORMED = "_malformed_line"
BAD_SCHEMA = "file string, line string"
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


class LoadError(ValueError):
    """A file that gives no table."""


@dataclass(frozen=True)
class Loaded:
    """Records, the rows that are none (file, line), their number, and what else to tell."""

    df: DataFrame
    bad: DataFrame
    bad_rows: int = 0
    warnings: list[str] = field(default_factory=list)


def file_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file, block, at, line)``: lines of text files with their order inside a block."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def local_name(uri: str) -> str:
    """The path of a file as readers take it: Spark tells names with signs like blanks written as %20."""
    return unquote(uri)


def opened(line: Column) -> tuple[Column, Column]:
    """Brackets a line opens less those it closes, outside strings; and whether one value follows another without a comma."""
    bare = F.regexp_replace(line, STRING, "0")
    number = lambda marks: F.length(bare) - F.length(F.translate(bare, marks, ""))
    return number("{[") - number("}]"), bare.rlike(r"[}\]]\s*[{\[]")


def documents_among(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """Files that are one document over several lines, and the others."""
    depth, glued = opened(F.col("line"))
    told = file_lines(spark, path).where(F.trim("line") != "").select("file", "block", "at", depth.alias("depth"), glued.alias("glued"))
    facts = told.groupBy("file").agg(F.min_by("depth", F.struct("block", "at")).alias("first"), F.sum("depth").alias("all"), F.bool_or("glued").alias("glued"))
    files = facts.select("file", ((F.col("first") > 0) & (F.col("all") == 0) & ~F.col("glued")).alias("may")).collect()
    candidates = [local_name(r.file) for r in files if r.may]
    others = [local_name(r.file) for r in files if not r.may]
    if not candidates:
        return [], others
    lines = file_lines(spark, candidates).where(F.trim("line") != "").select("file", "block", "at", depth.alias("depth"))
    inside = lines.withColumn("depth", F.sum("depth").over(Window.partitionBy("file", "block").orderBy("at")))
    ends = inside.groupBy("file", "block").agg(F.max_by("depth", "at").alias("sum"))
    low = inside.groupBy("file", "block", "depth").agg(F.count(F.lit(1)).alias("n")).groupBy("file", "block").agg(F.min(F.struct("depth", "n")).alias("low"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    blocks = ends.join(low, ["file", "block"]).select(
        "file", "low.n", (F.col("low.depth") + F.coalesce(F.sum("sum").over(before), F.lit(0))).alias("least"), last.alias("last"))
    # inside brackets at every line break, but for the end of the last line
    sound = F.when(F.col("last"), (F.col("least") == 0) & (F.col("n") == 1)).otherwise(F.col("least") > 0)
    proven = {local_name(r.file) for r in blocks.groupBy("file").agg(F.bool_and(sound).alias("sound")).where("sound").collect()}
    return sorted(proven), sorted([*others, *(f for f in candidates if f not in proven)])


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of both: structs and lists by their parts, numbers widened, else text."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        of = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            of[f.name] = merged_type(of[f.name], f.dataType) if f.name in of else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in of.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def _reader(spark: SparkSession, whole: bool, root: str | None):
    reader = spark.read.option("columnNameOfCorruptRecord", MALFORMED).option("multiLine", whole)
    return reader.option("basePath", root) if root else reader


def _is_record(text: Column) -> Column:
    """Whether a line that did not fit the schema is a JSON record, or a list of some, all the same."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).rlike("^(OBJECT|ARRAY<OBJECT)"), F.lit(False))


def _names_of_folders(spark: SparkSession, paths: str | Sequence[str], own: T.StructType, whole: bool, root: str | None) -> T.StructType:
    """The schema of records with the columns that folder names give; only names are listed, no record is read again."""
    probe = T.StructType([T.StructField("_none", T.StringType())])
    folders = {f.name: f for f in _reader(spark, whole, root).schema(probe).json(paths).schema.fields if f.name != "_none"}
    return T.StructType([*(folders.pop(f.name, f) for f in own.fields), *folders.values()])


def _split(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, whole: bool, root: str | None, whole_numbers: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, int, int]:
    """Records, malformed rows, the number of these, and the number of records with a value that does not fit.

    ``whole_numbers`` are text columns that hold nothing else in these files: asked for a number as text, the reader goes back to
    the file for every single value of a document, so they are read as numbers."""
    fields = [T.StructField(f.name, T.LongType()) if f.name in whole_numbers else f for f in schema.fields]
    full = T.StructType([*fields, T.StructField(MALFORMED, T.StringType())])
    raw = _reader(spark, whole, root).schema(full).json(paths)
    text = F.col(MALFORMED)
    # another column is named because the reader refuses to be asked for the malformed lines alone
    named = F.length(F.concat_ws("", col(schema.fields[0].name).cast("string"))) >= 0
    broken = text.isNotNull() & ~_is_record(text)
    # a value is only found not to fit where its column is asked for
    every = F.length(F.concat_ws("", *[col(f.name).cast("string") for f in schema.fields])) >= 0
    counts = raw.agg(F.count_if(broken & every).alias("bad"), F.count_if(text.isNotNull() & ~broken & every).alias("misfit")).first()
    bad = raw.where(broken & named).select(F.col("_metadata.file_path").alias("file"), text.alias("line"))
    records = raw.where(~broken & named).drop(MALFORMED)
    return records.withColumns({c: col(c).cast("string") for c in whole_numbers}), bad, counts["bad"], counts["misfit"]


def _inferred(spark: SparkSession, paths: str | Sequence[str], whole: bool) -> tuple[T.StructType, bool]:
    """The schema of the records themselves, and whether some could not be read."""
    found = _reader(spark, whole, None).option("recursiveFileLookup", True).json(paths).schema
    return T.StructType([f for f in found.fields if f.name != MALFORMED]), MALFORMED in found.names


def read_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, layout: str | None = None) -> Loaded:
    """JSON files as records. Each file is lines or one document, by the proof above; ``layout`` ("lines" or "document") states
    it for all and saves the pass. Lines that are no JSON record are left out, counted and kept in ``bad``; with ``schema`` a
    value that does not fit is null and its record counted. Files that give no record at all raise."""
    if layout is None:
        documents, lines = documents_among(spark, path)
    else:
        documents, lines = ([], [path]) if layout == "lines" else ([path], [])
    known = {}
    if documents and layout is None:
        # brackets alone do not prove a document: one that does not parse is read as lines, which reports it
        known[True], unread = _inferred(spark, documents, True) if schema is None else (None, True)
        failed = set()
        if unread:
            probe = T.StructType([T.StructField("_none", T.StringType()), T.StructField(MALFORMED, T.StringType())])
            broken = _reader(spark, True, None).schema(probe).json(documents).where(F.col(MALFORMED).isNotNull() & F.col("_none").isNull())
            failed = {local_name(r.file) for r in broken.select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
        if failed:
            documents, lines, known = [d for d in documents if d not in failed], [*lines, *(d for d in documents if d in failed)], {}
    root = path if isinstance(path, str) and documents and lines else None
    if root is not None and len(documents) + len(lines) == 1:
        root = None
    parts = [(path if not (documents and lines) else files, whole) for files, whole in ((lines, False), (documents, True)) if files]
    whole_numbers = {}
    if schema is None:
        own = {whole: known.get(whole) or _inferred(spark, files, whole)[0] for files, whole in parts}
        # names of folders are columns, too, but no records
        found = [s for files, whole in parts if (s := _names_of_folders(spark, files, own[whole], whole, root))]
        names = {f.name for s in own.values() for f in s.fields}
        if not names:
            if parts and not spark.read.text(path).where(F.trim("value") != "").isEmpty():
                raise LoadError("no JSON records")
            empty = spark.createDataFrame([], T.StructType())
            return Loaded(empty, spark.createDataFrame([], BAD_SCHEMA))
        merged = found[0]
        for s in found[1:]:
            merged = merged_type(merged, s)
        schema = T.StructType(sorted(merged.fields, key=lambda f: f.name not in names))
        folders = {f.name for s in found for f in s.fields} - names
        if True in own:
            text = {f.name for f in schema.fields if f.dataType == T.StringType()} - folders
            whole_numbers[True] = [f.name for f in found[-1].fields if f.name in text and f.dataType == T.LongType()]
    read = [_split(spark, files, schema, whole, root, whole_numbers.get(whole, ())) for files, whole in parts]
    if not read:
        return Loaded(spark.createDataFrame([], schema), spark.createDataFrame([], BAD_SCHEMA))
    df, bad = read[0][:2]
    for more, worse, *_ in read[1:]:
        df, bad = df.unionByName(more), bad.unionByName(worse)
    n, misfit = (sum(r[k] for r in read) for k in (2, 3))
    warnings = [f"{n} lines are no JSON records"] if n else []
    warnings += [f"{misfit} records have values that do not fit the schema"] if misfit else []
    return Loaded(df, bad, n, warnings)
