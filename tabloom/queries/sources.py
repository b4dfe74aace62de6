"""Readers and writers: the given tables are written in a format, read back and compared with themselves."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning as C, joins as J
from ..session import scratch_path
from ..sources import catalog as G, jsonshape as Z, readers as R, sinks as S
from .registry import query
from .sqltext import union


def _written(df, writer, label, **options):
    path = scratch_path(df.sparkSession, label)
    writer(df, path, **options)
    return df.sparkSession, path


@query("s01_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s01(t):
    return R.read_csv(*_written(t("customer"), S.write_csv, "csv"))


@query("s01b_csv_missing_words", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS n, lang FROM documents")
def s01b(t):
    df = t("documents").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN element_at(array('NA', 'n/a', 'null'), CAST(doc_id % 9 / 3 + 1 AS INT)) ELSE CAST(n_chars AS STRING) END").alias("n"), "lang")
    return R.read_csv(*_written(df, S.write_csv, "csv"))


@query("s01c_csv_quoted_text", "SELECT conv_id, turn, role, text FROM conversations")
def s01c(t):
    """Texts with commas, quotes and line breaks."""
    spark, path = _written(t("conversations"), S.write_csv, "csv")
    return R.read_csv(spark, path, multi_line=True)


def _dirty_csv(t, break_every: int = 0):
    """Customers as raw lines: every seventh has a field too many, every eleventh one too few, every thirteenth a word for its balance."""
    quoted = f"CASE WHEN c_custkey % {break_every} = 0 THEN '\"' || c_name || chr(10) || 'x\"' ELSE c_name END" if break_every else "c_name"
    line = f"""concat_ws(',', c_custkey, {quoted}, CASE WHEN c_custkey % 13 = 0 THEN 'much' ELSE string(c_acctbal) END,
      CASE WHEN c_custkey % 7 = 0 THEN 'more,fields' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END)"""
    df = t("customer")
    path = scratch_path(df.sparkSession, "csv")
    # a file of at most 1000 customers is one value, header included
    body = F.concat(F.lit("key,name,balance,segment\n"), F.array_join(F.collect_list(F.expr(line)), "\n"))
    df.groupBy(F.floor(F.col("c_custkey") / 1000).alias("chunk")).agg(body.alias("value")).write.partitionBy("chunk").text(path)
    return df.sparkSession, path


@query("s01d_csv_dirty_rows_with_schema", """
SELECT c_custkey AS key, c_name || CASE WHEN c_custkey % 17 = 0 THEN chr(10) || 'x' ELSE '' END AS name, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS balance,
  CASE WHEN c_custkey % 7 = 0 THEN 'more' WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment,
  (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0) AS bad_rows, (SELECT count(*) || ' rows have values that do not fit the schema' FROM customer WHERE c_custkey % 13 = 0) AS told
FROM customer""")
def s01d(t):
    """A given schema keeps all row checks; names with line breaks inside quotes stay whole."""
    loaded = R.read_delimited_checked(*_dirty_csv(t, 17), schema=T.StructType.fromDDL("key bigint, name string, balance double, segment string"))
    return loaded.df.select("key", "name", "balance", "segment", F.lit(loaded.bad_rows).cast("bigint").alias("bad_rows"), F.lit(loaded.warnings[-1]).alias("told"))


@query("s01e_csv_bad_rows", "SELECT c_custkey AS key, c_custkey % 7 = 0 AS surplus FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def s01e(t):
    """The side table of rows that do not fit the header."""
    bad = R.read_delimited_checked(*_dirty_csv(t)).bad
    return bad.select(F.substring_index("line", ",", 1).cast("bigint").alias("key"), F.col("line").contains("more,fields").alias("surplus"))


@query("s02_tsv", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def s02(t):
    return R.read_tsv(*_written(t("part"), S.write_csv, "tsv", sep="\t"))


@query("s03_parquet", "SELECT * FROM supplier")
def s03(t):
    return R.read_parquet(*_written(t("supplier"), S.write_parquet, "parquet"))


@query("s04_json_lines", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def s04(t):
    return R.read_json(*_written(t("nation"), S.write_json, "json"))


@query("s04b_json_document", "SELECT c_custkey, c_name FROM customer")
def s04b(t):
    """Files that are one indented JSON document each: no single line is a record."""
    df = t("customer")
    text = F.concat(F.lit('{\n  "c_custkey": '), F.col("c_custkey").cast("string"), F.lit(',\n  "c_name":\n    "'), "c_name", F.lit('"\n}'))
    path = scratch_path(df.sparkSession, "json")
    # files of at most 1000 customers, each file one indented array
    body = F.concat(F.lit("[\n"), F.array_join(F.collect_list(text), ",\n"), F.lit("\n]"))
    chunk = F.floor(F.col("c_custkey") / 1000).alias("chunk")
    df.groupBy(chunk).agg(body.alias("value")).write.partitionBy("chunk").text(path)
    return R.read_json(df.sparkSession, path).select("c_custkey", "c_name")


def _dirty_lines(t):
    """Orders as JSON lines of which every fifth is cut off and every eleventh is no object."""
    line = """CASE WHEN o_orderkey % 5 = 0 THEN '{"k": ' || o_orderkey || ', "who": {"c": ' WHEN o_orderkey % 11 = 0 THEN string(o_orderkey)
      ELSE '{"k": ' || o_orderkey || ', "who": {"c": ' || o_custkey || '}, "s": "' || o_orderstatus || '{["}' END"""
    df = t("orders")
    path = scratch_path(df.sparkSession, "json")
    df.select(F.expr(line).alias("value")).write.text(path)
    return df.sparkSession, path


@query("s04c_json_dirty_lines", """
SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus || '{[' AS s, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 11 = 0) || ' lines are no JSON records' AS told
FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0""")
def s04c(t):
    """Good lines stay, whatever the share of malformed ones."""
    loaded = R.read_records(*_dirty_lines(t))
    return loaded.df.select("k", "who.c", "s", F.lit(loaded.warnings[0]).alias("told"))


@query("s04d_json_bad_lines", """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN '{"k": ' || o_orderkey || ', "who": {"c":' ELSE CAST(o_orderkey AS VARCHAR) END AS line FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 11 = 0""")
def s04d(t):
    """The side table of malformed lines."""
    return R.read_records(*_dirty_lines(t)).bad.select(F.rtrim("line").alias("line"))


@query("s04e_json_dirty_lines_with_schema", """
SELECT o_orderkey AS k, CAST(NULL AS BIGINT) AS s, (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0) || ' records have values that do not fit the schema' AS told
FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0""")
def s04e(t):
    """With a schema: malformed lines are left out and counted, values of another type are null and their records counted."""
    loaded = R.read_records(*_dirty_lines(t), T.StructType.fromDDL("k bigint, s bigint"))
    return loaded.df.select("k", "s", F.lit(loaded.warnings[1]).alias("told"))


@query("s04f_json_lines_beside_documents", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'c' || o_custkey END AS c FROM orders""")
def s04f(t):
    """A folder of both: even orders as indented arrays of at most 10,000, odd ones as lines; their types are merged."""
    df = t("orders")
    path = scratch_path(df.sparkSession, "json")
    even = df.where("o_orderkey % 2 = 0").select(F.floor(F.col("o_orderkey") / 20000).alias("chunk"), F.expr("""'{\n "k": ' || o_orderkey || ',\n "c": ' || o_custkey || '\n}'""").alias("value"))
    even.groupBy("chunk").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value")).write.partitionBy("chunk").text(path)
    df.where("o_orderkey % 2 = 1").select(F.expr("""'{"k": ' || o_orderkey || ', "c": "c' || o_custkey || '"}'""").alias("value"), F.lit(-1).alias("chunk")).write.mode("append").partitionBy("chunk").text(path)
    return R.read_records(df.sparkSession, path).df.select("k", "c")


_LAYOUT_DOCS = """CASE o_orderkey % 6
  WHEN 0 THEN '[{"k": ' || o_orderkey || ', "who": {"c": ' || o_custkey || '}}, {"k": ' || (o_orderkey + 1) || ', "tags": [1, "x"]}]'
  WHEN 1 THEN '[["k", "status"], [' || o_orderkey || ', "' || o_orderstatus || '"]]'
  WHEN 2 THEN '{"rows": [{"k": ' || o_orderkey || '}], "total": 1}'
  WHEN 3 THEN '{"a": {"k": ' || o_orderkey || '}, "b": {"k": ' || o_custkey || '}}'
  WHEN 4 THEN '{"k": ' || o_orderkey || ', "status": "' || o_orderstatus || '"}'
  ELSE '{"k": ' || o_orderkey || '}' || chr(10) || '{"k": ' || o_custkey || '}' END"""


def _layout_docs(t):
    return t("orders").select(F.col("o_orderkey").alias("doc"), F.expr(_LAYOUT_DOCS).alias("text"))


@query("s05_json_layouts", """
SELECT o_orderkey AS doc, CASE o_orderkey % 6 WHEN 0 THEN 'array_of_objects' WHEN 1 THEN 'array_of_arrays' WHEN 2 THEN 'wrapped_array' WHEN 3 THEN 'object_of_objects'
  WHEN 4 THEN 'single_object' ELSE 'ndjson' END AS layout, CASE WHEN o_orderkey % 6 IN (0, 3, 5) THEN 2 ELSE 1 END AS root_records FROM orders""", spread=True)
def s05(t):
    return Z.document_layouts(_layout_docs(t)).select("doc", "layout", "root_records")


@query("s05b_json_records_flat", union([
    "SELECT o_orderkey AS doc, 0 AS pos, o_orderkey AS k, CASE WHEN o_orderkey % 6 IN (1, 4) THEN o_orderstatus END AS status, "
    "CASE WHEN o_orderkey % 6 = 0 THEN o_custkey END AS who__c, NULL AS tags, CASE WHEN o_orderkey % 6 = 3 THEN 'a' END AS _key FROM orders",
    "SELECT o_orderkey, 1, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 1 ELSE o_custkey END, NULL, NULL, CASE WHEN o_orderkey % 6 = 0 THEN '[1,\"x\"]' END, "
    "CASE WHEN o_orderkey % 6 = 3 THEN 'b' END FROM orders WHERE o_orderkey % 6 IN (0, 3, 5)"]), spread=True)
def s05b(t):
    return Z.flatten_records(Z.extract_records(_layout_docs(t)))


@query("s06_latin1_fallback", "SELECT s_suppkey, 'Café ' || s_name AS label FROM supplier")
def s06(t):
    df = t("supplier").select("s_suppkey", F.concat(F.lit("Café "), "s_name").alias("label"))
    path = scratch_path(df.sparkSession, "latin1")
    df.write.csv(path, header=True, encoding="ISO-8859-1")
    return R.read_csv(df.sparkSession, path)


@query("s06b_encoding_per_file", "SELECT s_suppkey, 'Café ' || s_name AS label FROM supplier")
def s06b(t):
    """Latin-1 files beside UTF-8 files in one load: each is read in its own encoding."""
    df = t("supplier").select("s_suppkey", F.concat(F.lit("Café "), "s_name").alias("label"))
    path = scratch_path(df.sparkSession, "encodings")
    df.where("s_suppkey % 2 = 0").write.csv(path, header=True, encoding="ISO-8859-1")
    df.where("s_suppkey % 2 = 1").write.mode("append").csv(path, header=True, encoding="UTF-8")
    return R.read_csv(df.sparkSession, path)


@query("s07_narrow_types", union([
    f"SELECT '{c}' AS \"column\", CASE WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS type, "
    f"CAST(min({c}) AS BIGINT) AS lo, CAST(max({c}) AS BIGINT) AS hi FROM {t}" for c, t in (
        ("l_orderkey", "lineitem"), ("l_partkey", "lineitem"), ("l_suppkey", "lineitem"), ("l_linenumber", "lineitem"))]))
def s07(t):
    df = R.narrow_types(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    kinds = df.dtypes
    one = df.agg(*[e for c, _ in kinds for e in (F.min(c).cast("bigint").alias(f"lo_{c}"), F.max(c).cast("bigint").alias(f"hi_{c}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c, k in kinds])))


@query("s08_load_validation", """
SELECT 'customers' AS file, CASE WHEN count(*) > 0 THEN 'rows: ' || count(*) END AS status FROM customer
UNION ALL SELECT DISTINCT 'header only', 'the table has no rows' FROM customer UNION ALL SELECT DISTINCT 'no records', 'no JSON records' FROM customer
UNION ALL SELECT DISTINCT 'sheet', 'Unsupported format: xls' FROM customer""")
def s08(t):
    """What loading says of a good table, of one without rows, of text that is no JSON, and of an unknown format."""
    df = t("customer")
    spark = df.sparkSession
    good, header, text = (scratch_path(spark, x) for x in ("good", "header", "text"))
    S.write_csv(df, good)
    S.write_csv(df.where("c_custkey < 0").coalesce(1), header)
    df.select(F.concat(F.lit("{"), "c_name").alias("value")).write.text(text)
    rows = []
    for name, path, kind in (("customers", good, "csv"), ("header only", header, "csv"), ("no records", text, "json"), ("sheet", good, "xls")):
        try:
            rows.append((name, f"rows: {R.load(spark, path, kind)[1].row_count}"))
        except R.LoadError as problem:
            rows.append((name, str(problem)))
    return spark.createDataFrame(rows, "file string, status string")


@query("s09_load_report", "SELECT count(*) AS row_count, 6 AS col_count FROM orders")
def s09(t):
    spark, path = _written(t("orders"), S.write_csv, "csv")
    df, report = R.load(spark, path, "csv")
    return R.load_report(R.check_loaded(df)).where(F.lit(report.row_count) == F.col("row_count"))


@query("s10_scan_tables", """
SELECT 'customer' AS source, CAST(count(*) AS BIGINT) AS rows, 5 AS columns, 'loaded' AS status FROM customer
UNION ALL SELECT 'nation', count(*), 3, 'loaded' FROM nation UNION ALL SELECT 'supplier', count(*), 4, 'loaded' FROM supplier""")
def s10(t):
    spark = t("nation").sparkSession
    root = scratch_path(spark, "tables")
    S.write_csv(t("customer").coalesce(1), f"{root}/customer")
    S.write_csv(t("supplier").coalesce(1), f"{root}/supplier")
    S.write_json(t("nation").coalesce(1), f"{root}/nation")
    _, catalog = G.scan_tables(spark, root)
    return catalog.select(F.regexp_extract("path", "^([a-z]+)/", 1).alias("source"), "rows", "columns", "status")


@query("s10b_catalog_of_dirty_files", """
SELECT 'customer' AS source, count(*) AS rows, count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 11 = 0) AS bad_rows, count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 11 = 0) || ' rows have more or fewer fields than the header' AS told FROM customer""")
def s10b(t):
    """Malformed rows reach the catalog, per file."""
    spark = t("customer").sparkSession
    root = scratch_path(spark, "dirty")
    lines = spark.read.text(_dirty_csv(t)[1]).where("value not like 'key,%'").coalesce(1)
    lines.select(F.col("value").alias("key,name,balance,segment")).write.option("header", True).csv(f"{root}/customer", quote="", escapeQuotes=False, sep="\x01")
    catalog = G.scan_tables(spark, root)[1]
    return catalog.select(F.regexp_extract("path", "([a-z]+)[^/]*/[^/]*$", 1).alias("source"), "rows", "bad_rows", F.get("warnings", F.lit(0)).alias("told"))


@query("s11_table_names", """
SELECT 'customer' AS folder, 'customer_part' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'Supplier list', 'supplier_list_part', count(*) FROM supplier
UNION ALL SELECT 'nation', 'nation_part', count(*) FROM nation""")
def s11(t):
    """Names that a folder's files get from their paths; what a writer adds to a file name is left out."""
    _, catalog = _named_tables(t)
    return catalog.select(F.substring_index("path", "/", 1).alias("folder"), F.regexp_extract("table", "^(.*?part)", 1).alias("name"), "rows")


def _named_tables(t):
    spark = t("nation").sparkSession
    root = scratch_path(spark, "named")
    for name, folder in (("customer", "customer"), ("supplier", "Supplier list"), ("nation", "nation")):
        S.write_csv(t(name).coalesce(1), f"{root}/{folder}")
    return G.scan_tables(spark, root)


@query("s12_find_table", "SELECT s_suppkey, s_name FROM supplier")
def s12(t):
    """A table found by the end of its name, in any case."""
    tables, _ = _named_tables(t)
    ending = next(n for n in tables if n.startswith("supplier"))[len("supplier_"):]
    return tables[G.find_table(tables, ending.upper())].select("s_suppkey", "s_name")


@query("s14_csv_export", "SELECT source_table, source_column, target_table, matched_values FROM (SELECT 'nation' AS source_table, 'n_regionkey' AS source_column, 'region' AS target_table, count(DISTINCT n_regionkey) AS matched_values FROM nation)")
def s14(t):
    from ..operators.discovery import infer_relationships

    edges = infer_relationships({"nation": t("nation").select("n_regionkey", "n_name"), "region": t("region")}, ["r_regionkey"])
    spark, path = _written(edges, S.write_csv, "edges")
    return R.read_csv(spark, path).select("source_table", "source_column", "target_table", "matched_values")


@query("s15_log_sink", """
SELECT DISTINCT 'SchemaAnalyzer' AS step_name, 'role_assignment' AS action, 'info' AS severity, CAST(2 * 6 AS BIGINT) AS entries FROM orders
UNION ALL SELECT DISTINCT 'ColumnNormalizer', 'rename_column', 'info', 2 FROM orders""")
def s15(t):
    df = t("orders").withColumnRenamed("o_orderkey", "Order Key")
    path = scratch_path(df.sparkSession, "log")
    for _ in range(2):  # two runs append to one log
        result = C.clean(df, steps=(C.normalize_columns, C.infer_roles))
        S.append_log(result.log_frame(), path)
    return df.sparkSession.read.parquet(path).groupBy("step_name", "action", "severity").agg(F.count(F.lit(1)).alias("entries"))


@query("s16_merge_history", """
SELECT 'c_custkey' AS left_col, 'o_custkey' AS right_col, 'numeric' AS strategy, 'inner' AS join_type, count(*) AS merged_rows, count(*) AS matched_rows, CAST(0 AS BIGINT) AS left_only_rows,
  CAST(0 AS BIGINT) AS right_only_rows, 1 AS warnings FROM customer JOIN orders ON c_custkey = o_custkey""")
def s16(t):
    l, r = t("customer"), t("orders")
    args = ("c_custkey", "o_custkey", "numeric", "inner")
    record = S.merge_record(J.match_stats(l, r, *args), *args, J.join_warnings(l, r, *args))
    path = scratch_path(l.sparkSession, "history")
    S.append_merge(record, path)
    page = S.history_page(l.sparkSession.read.parquet(path))
    return page.drop("created_at").withColumn("warnings", F.size("warnings"))


@query("s17_to_storable", """
SELECT c_custkey, '{"n":' || c_nationkey || ',"s":"' || c_mktsegment || '"}' AS nested, '["' || c_name || '"]' AS list, c_name AS blob FROM customer""")
def s17(t):
    df = t("customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).alias("nested"),
                              F.array("c_name").alias("list"), F.encode("c_name", "UTF-8").alias("blob"))
    return S.to_storable(df)
