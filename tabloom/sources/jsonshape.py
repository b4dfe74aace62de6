"""JSON documents of unknown layout: recognise the layout, take out the records, flatten and profile them.

The unit is a DataFrame of documents ``(doc, text)``: one row per file, or one row per JSON value held in a text column.
Documents are parsed to VARIANT once and everything after that is a column expression, so many documents are handled in
parallel. One single huge document is one row by nature; newline-delimited files are read line by line instead.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.names import json_column_name
from ..functions.text import HINT_PATTERNS, hint_match
from ..operators.shape import col

# Limits and labels of the field profile.
MAX_WALK_DEPTH, DEEP_NESTING, HINT_SHARE, MANY_NULLS = 8, 3, 0.7, 0.5
VALUE_TYPES = ["str", "int", "float", "bool", "dict", "list"]
KINDS = {"str": "string", "int": "number", "float": "number", "bool": "boolean", "dict": "object", "list": "array"}
OBJECT_SHARE = 0.8


def value_type(v: Column) -> Column:
    """``null bool int float str list dict`` of a VARIANT value."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), "null")
        .when(s == "BOOLEAN", "bool")
        .when((s == "BIGINT") | s.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$"), "int")
        .when(s.startswith("ARRAY"), "list")
        .when(s.startswith("OBJECT"), "dict")
        .when(s == "STRING", "str")
        .otherwise("float")
    )


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT" if kind == "dict" else "ARRAY")


def _wrap(v: Column) -> Column:
    return F.to_variant_object(F.create_map(F.lit("value"), v))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``(doc, text)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, pos, record)`` of newline-delimited files; files are split by lines, so size does not matter."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc"), F.monotonically_increasing_id().alias("pos"),
                                         F.try_parse_json(F.trim("value")).alias("record"))
    return lines.where(F.col("record").isNotNull())


def with_layout(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``layout``, ``array_keys`` and the parsed parts used to take out records."""
    lines = F.filter(F.transform(F.split(F.trim(col(text)), "\n"), F.trim), lambda x: x != "")
    # the parser stops after the first value, so line-by-line documents are recognised before the whole text is parsed
    several = F.when(F.size(lines) >= 2, F.transform(lines, lambda x: F.try_parse_json(x)))
    is_record = lambda x: F.coalesce(_is(x, "dict"), F.lit(False))
    records = F.filter(several, is_record)
    # most lines are records, the first among them; the others are broken lines and are counted
    by_line = is_record(F.get(several, F.lit(0))) & (2 * F.size(records) > F.size(several))
    d = docs.withColumn("_lines", F.when(by_line, records)).withColumn(
        "bad_lines", F.when(by_line, F.size(several) - F.size(records)).otherwise(0))
    d = d.withColumn("_doc", F.when(F.col("_lines").isNull(), F.try_parse_json(col(text))))
    d = d.withColumn("_root", value_type(F.col("_doc"))).withColumn(
        "_items", F.when(F.col("_root") == "list", _as_array(F.col("_doc")))).withColumn(
        "_entries", F.when(F.col("_root") == "dict", F.map_entries(_as_map(F.col("_doc")))))
    holds_records = lambda e: F.coalesce(
        _is(e["value"], "list") & _is(F.get(_as_array(e["value"]), F.lit(0)), "dict"), F.lit(False))
    d = d.withColumn("array_keys", F.coalesce(
        F.transform(F.filter("_entries", holds_records), lambda e: e["key"]), F.array().cast("array<string>")))
    n = F.size("_items")
    n_dict, n_list = F.size(F.filter("_items", lambda x: _is(x, "dict"))), F.size(F.filter("_items", lambda x: _is(x, "list")))
    n_sub = F.size(F.filter("_entries", lambda e: _is(e["value"], "dict")))
    in_array = (
        F.when(n == 0, "empty").when(n_dict / n >= OBJECT_SHARE, "array_of_objects").when(n_list / n >= OBJECT_SHARE, "array_of_arrays")
        .when((n_dict == 0) & (n_list == 0), "array_of_scalars").otherwise("mixed_array"))
    in_object = (
        F.when(F.size("array_keys") == 1, "wrapped_array").when(F.size("array_keys") > 1, "wrapped_multi")
        .when(n_sub / F.greatest(F.size("_entries"), F.lit(1)) >= OBJECT_SHARE, "object_of_objects").otherwise("single_object"))
    layout = (
        F.when(F.col("_lines").isNotNull(), "ndjson").when(F.col("_doc").isNull(), "unknown")
        .when(F.col("_root") == "null", "empty").when(F.col("_root") == "list", in_array)
        .when(F.col("_root") == "dict", in_object).otherwise("unknown"))
    return d.withColumn("layout", layout)


def _records(layout: Column) -> Column:
    """Array of record VARIANTs of a document, by its layout."""
    as_record = lambda x: F.when(_is(x, "dict"), x).otherwise(_wrap(x))
    first = _as_array(F.get("_items", F.lit(0)))
    is_header = F.forall(first, lambda x: F.schema_of_variant(x) == "STRING")
    header = F.when(is_header, F.transform(first, lambda x: F.try_variant_get(x, "$", "string"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    body = F.when(is_header, F.slice("_items", 2, F.greatest(F.size("_items") - 1, F.lit(0)))).otherwise(F.col("_items"))

    def row(x: Column) -> Column:
        cells = _as_array(x)
        width = F.least(F.size(header), F.size(cells))
        return F.to_variant_object(F.map_from_arrays(F.slice(header, F.lit(1), width), F.slice(cells, F.lit(1), width)))

    def keyed(e: Column) -> Column:
        inner = F.when(_is(e["value"], "dict"), _as_map(e["value"])).otherwise(F.create_map(F.lit("value"), e["value"]))
        named = F.when(F.map_contains_key(inner, "_key"), inner).otherwise(
            F.map_concat(inner, F.create_map(F.lit("_key"), e["key"].cast("variant"))))
        return F.to_variant_object(named)

    sized = F.transform(F.filter("_entries", lambda e: F.array_contains(F.col("array_keys"), e["key"])),
                        lambda e: F.struct(F.size(_as_array(e["value"])).alias("n"), e["value"].alias("v")))
    largest = F.aggregate(sized, F.get(sized, F.lit(0)), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
    return (
        F.when(layout.isin("array_of_objects", "array_of_scalars", "mixed_array"), F.transform("_items", as_record))
        .when(layout == "array_of_arrays", F.transform(body, row))
        .when(layout.isin("wrapped_array", "wrapped_multi"), F.transform(_as_array(largest["v"]), as_record))
        .when(layout == "object_of_objects", F.transform("_entries", keyed))
        .when(layout == "single_object", F.array("_doc"))
        .when(layout == "ndjson", F.col("_lines"))
    )


def document_layouts(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``(doc, layout, root_records, array_keys)`` per document."""
    d = with_layout(docs, text)
    return d.select(col(doc), "layout", F.coalesce(F.size(_records(F.col("layout"))), F.lit(0)).alias("root_records"), "array_keys")


def document_problems(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``(doc, bad_lines, arrays_left_out, no_records)`` per document: what reading its records leaves out."""
    d = with_layout(docs, text)
    return d.select(col(doc), "bad_lines", F.greatest(F.size("array_keys") - 1, F.lit(0)).alias("arrays_left_out"),
                    (F.coalesce(F.size(_records(F.col("layout"))), F.lit(0)) == 0).alias("no_records"))


def document_warnings(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``(doc, warning)``: one row per thing that reading a document's records leaves out or cannot do."""
    d = with_layout(docs, text)
    none = F.coalesce(F.size(_records(F.col("layout"))), F.lit(0)) == 0
    told = F.array_compact(F.array(
        F.when(F.col("layout") == "unknown", "unknown layout: no JSON document and no JSON lines"),
        F.when(F.col("layout") == "empty", "empty document"),
        F.when(none & ~F.col("layout").isin("unknown", "empty"), "no records"),
        F.when(F.col("layout") == "wrapped_multi", F.concat(F.lit("several arrays, only the largest is used: "), F.array_join("array_keys", ", "))),
        F.when(F.col("bad_lines") > 0, F.concat(F.col("bad_lines").cast("string"), F.lit(" lines are no JSON records")))))
    return d.select(col(doc), F.explode(told).alias("warning"))


def extract_records(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``(doc, pos, record)``: every record of every document as VARIANT."""
    d = with_layout(docs, text)
    return d.select(col(doc), F.posexplode(_records(F.col("layout"))).alias("pos", "record"))


def _ddl_type(spark: SparkSession, merged: str) -> T.DataType:
    # only where a type stands: at the start, after a field's colon or inside an array; never inside a name
    ddl = re.sub(r"(^|: |ARRAY<)OBJECT<", r"\1STRUCT<", merged)
    return T.DataType.fromDDL(re.sub(r"(^|: |ARRAY<)VOID(?=[,>]|$)", r"\1STRING", ddl))


def _distinct_names(names: Sequence[str]) -> list[str]:
    """Names made different in more than case, by numbers after the later ones."""
    taken: set[str] = set()
    out = []
    for name in names:
        numbered = (name if not k else f"{name}_{k}" for k in itertools.count())
        out.append(next(n for n in numbered if n.lower() not in taken))
        taken.add(out[-1].lower())
    return out


def _json_path(keys: Sequence[str]) -> str:
    """Path of nested keys, quoted so that dots and spaces in a key stay part of it."""
    return "$" + "".join(f"['{k}']" if "'" not in k else f'["{k}"]' for k in keys)


def flatten_records(records: DataFrame, keep: tuple[str, ...] = ("doc", "pos")) -> DataFrame:
    """Records as columns: nested objects become ``a__b``, arrays and mixed values JSON text.

    One merging aggregate finds the common schema; the cast to it keeps whole columns typed.
    """
    merged = records.agg(F.schema_of_variant_agg("record")).first()[0]
    shape = _ddl_type(records.sparkSession, merged) if merged else T.StructType()
    if not isinstance(shape, T.StructType) or not shape.fields:
        return records.select(*[col(k) for k in keep])

    def leaves(struct: T.StructType, above: tuple[str, ...]):
        for f in struct.fields:
            keys = (*above, f.name)
            path, name = _json_path(keys), json_column_name("__".join(keys))
            if isinstance(f.dataType, T.StructType) and f.dataType.fields:
                yield from leaves(f.dataType, keys)
            elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
                yield name, F.to_json(F.try_variant_get("record", path, "variant"))
            elif isinstance(f.dataType, T.VariantType):
                here = F.try_variant_get("record", path, "variant")
                yield name, F.coalesce(F.try_variant_get(here, "$", "string"), F.to_json(here))
            else:
                yield name, F.try_variant_get("record", path, f.dataType.simpleString())

    # keys are told apart by case and by path, result columns are not; so their names are made distinct
    found = list(leaves(shape, ()))
    names = _distinct_names([*keep, *[n for n, _ in found]])[len(keep):]
    return records.select(*[col(k) for k in keep], *[c.alias(n) for n, (_, c) in zip(names, found, strict=True)])


def load_json_structural(spark: SparkSession, path: str) -> DataFrame:
    """Files of any recognised layout as one flat table."""
    return flatten_records(extract_records(read_documents(spark, path)))


def walk_values(records: DataFrame, record: str = "record", max_depth: int = MAX_WALK_DEPTH) -> DataFrame:
    """``(path, type, text)`` of every value below every record; a container below ``max_depth`` levels is one text value.

    Each level is one ``explode`` in a single linear plan: finished values pass through, containers open up.
    An array of objects opens as ``path[*]``, any other array is one text value, an empty array is a missing value.
    """
    rows = records.select(F.lit("").alias("path"), col(record).alias("v"), F.lit(False).alias("done"))
    for depth in range(max_depth + 1):
        kind = value_type(F.col("v"))
        items, entries = _as_array(F.col("v")), F.map_entries(_as_map(F.col("v")))
        node = lambda p, v, d: F.struct(p.alias("path"), v.alias("v"), F.lit(d).alias("done"))
        keep = F.array(node(F.col("path"), F.col("v"), True))
        below = F.when(F.col("path") == "", F.lit("")).otherwise(F.concat("path", F.lit(".")))
        opened = F.transform(entries, lambda e: node(F.concat(below, e["key"]), e["value"], False))
        each = F.transform(items, lambda x: node(F.concat("path", F.lit("[*]")), x, False))
        if depth == max_depth:  # what lies deeper stays together as one text
            opened = each = F.array(node(F.col("path"), F.to_json("v").cast("variant"), True))
        rows = rows.withColumn("kind", kind).select(F.explode(
            F.when(F.col("done"), keep)
            .when((F.col("kind") == "dict") & (F.size(entries) > 0), opened)
            .when((F.col("kind") == "list") & (F.size(items) == 0), F.array(node(F.col("path"), F.parse_json(F.lit("null")), True)))
            .when((F.col("kind") == "list") & F.forall(items, lambda x: _is(x, "dict")), each)
            .when(F.col("kind") == "list", F.array(node(F.col("path"), F.to_json("v").cast("variant"), True)))
            .otherwise(keep)
        ).alias("n")).select("n.*")
    text = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    return rows.where(F.col("path") != "").select("path", value_type(F.col("v")).alias("type"), text.alias("text"))


def field_profile(records: DataFrame, record: str = "record", max_depth: int = MAX_WALK_DEPTH) -> DataFrame:
    """One row per JSON path: counts, null rate, type counts, distinct values, kind, array depth and content hints."""
    counted = walk_values(records, record, max_depth).groupBy("path", "type", "text").agg(F.count(F.lit(1)).alias("n"))
    of = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0))
    hits = lambda h: F.coalesce(F.sum(F.when((F.col("type") == "str") & hint_match(F.col("text"), h), F.col("n"))), F.lit(0))
    grouped = counted.groupBy("path").agg(
        F.sum("n").alias("count"), of("null").alias("null_count"), *[of(t).alias(f"n_{t}") for t in VALUE_TYPES],
        F.count_distinct(F.when(~F.col("type").isin("null", "dict", "list"), F.col("text"))).alias("n_unique"),
        *[hits(h).alias(f"h_{h}") for h in HINT_PATTERNS],
    )
    seen = F.col("count") > F.col("null_count")
    most = F.greatest(*[F.col(f"n_{t}") for t in VALUE_TYPES])
    dominant = F.coalesce(*[F.when(F.col(f"n_{t}") == most, KINDS[t]) for t in VALUE_TYPES])
    scalar = sum((F.col(f"n_{t}") for t in ("int", "float", "bool")), F.col("n_str"))
    structural = F.col("n_dict") + F.col("n_list")
    kind = F.when(~seen, "null").when((scalar > 0) & (structural > 0), "mixed").otherwise(dominant)
    depth = F.size(F.split("path", r"\[\*\]")) - 1
    hints = F.array_join(F.array_compact(F.array(*[
        F.when((F.col("n_str") > 0) & (F.col(f"h_{h}") / F.col("n_str") >= HINT_SHARE), F.lit(h)) for h in HINT_PATTERNS])), ", ")
    out = grouped.withColumn("kind", kind).withColumn("array_depth", depth)
    return out.select(
        "path", "kind", "count", "null_count", F.round(F.col("null_count") / F.col("count"), 4).alias("null_rate"),
        *[f"n_{t}" for t in VALUE_TYPES], "n_unique", "array_depth",
        (F.col("kind").isin("object", "mixed") | (depth > 0)).alias("is_nested"), hints.alias("hints"),
    ).orderBy("array_depth", F.size(F.split("path", r"\.")), "path")


def field_samples(records: DataFrame, k: int = 8, record: str = "record") -> DataFrame:
    """Up to ``k`` distinct example values per path, most frequent first."""
    from ..operators.windows import top_per_group

    counted = walk_values(records, record).where(F.col("type") != "null").groupBy("path", "text").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counted, "path", [F.col("n").desc(), F.col("text")], k)


def nesting_depth(record: Column) -> Column:
    """Levels of containers in a record, read off its schema text; empty objects add none."""
    marks = F.regexp_extract_all(F.replace(F.schema_of_variant(record), F.lit("OBJECT<>"), F.lit("")), F.lit("[<>]"), 0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(a: Column, mark: Column) -> Column:
        now = a["now"] + F.when(mark == "<", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["top"], now).alias("top"))

    return F.aggregate(marks, start, step, lambda a: a["top"])


def structural_warnings(records: DataFrame, record: str = "record") -> DataFrame:
    """One row of flags: depth above 3, nested fields, mixed fields, fields more than half null."""
    fields = field_profile(records, record)
    depth = records.agg(F.max(nesting_depth(col(record)))).scalar()
    return fields.agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if("is_nested").alias("nested_fields"),
        F.count_if(F.col("kind") == "mixed").alias("mixed_fields"), F.count_if(F.col("null_rate") > MANY_NULLS).alias("high_null_fields"),
    ).withColumn("max_depth", depth).withColumn("deep_nesting", F.col("max_depth") > DEEP_NESTING)
