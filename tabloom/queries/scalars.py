"""Scalar functions and name functions, exercised on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import dates as D, grades as G, keys as K, names as N, text as X
from ..sources import jsonshape as J
from .registry import query
from .sqltext import PLACEHOLDER_LIST, date, key, number

STR, BIG = T.StringType(), T.LongType()

# Several spellings of one customer name, so that every key strategy has work to do.
_SPELL = ("CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN '  ' || replace(c_name, '#', ' ') || ' é' "
          "ELSE 'Ünit-' || c_custkey || '/x' END")
# Spellings of one order date.
_DATES = ("CASE o_orderkey % 6 WHEN 0 THEN {iso} WHEN 1 THEN {slash} WHEN 2 THEN {dmy} WHEN 3 THEN {compact} WHEN 4 THEN {name} "
          "ELSE 'no date ' || o_orderkey END")
_DATES_SPARK = _DATES.format(
    iso="date_format(o_orderdate, 'yyyy-MM-dd')", slash="date_format(o_orderdate, 'yyyy/M/d')",
    dmy="date_format(o_orderdate, 'd/M/yyyy')", compact="date_format(o_orderdate, 'yyyyMMdd')",
    name="date_format(o_orderdate, 'MMM d yyyy')")
_DATES_SQL = _DATES.format(
    iso="strftime(o_orderdate, '%Y-%m-%d')", slash="strftime(o_orderdate, '%Y/%-m/%-d')", dmy="strftime(o_orderdate, '%-d/%-m/%Y')",
    compact="strftime(o_orderdate, '%Y%m%d')", name="strftime(o_orderdate, '%b %-d %Y')")


def _keys_sql(strategy: str) -> str:
    return f"SELECT c_custkey, {key('spelling', strategy)} AS join_key FROM (SELECT c_custkey, {_SPELL} AS spelling FROM customer)"


def _key_query(name: str, strategy: str):
    @query(name, _keys_sql(strategy))
    def run(t):
        rows = t("customer").select("c_custkey", F.expr(_SPELL).alias("spelling"))
        return rows.select("c_custkey", K.join_key(F.col("spelling"), STR, strategy).alias("join_key"))


_key_query("h01_key_exact", K.EXACT)
_key_query("h02_key_casefold", K.CASEFOLD)
_key_query("h05_key_id_strip", K.ID_STRIP)
_key_query("h06_key_slug", K.SLUG)


@query("h03_key_numeric", f"""
SELECT p_partkey, {key('v', 'numeric')} AS join_key FROM (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN p_partkey || '.0'
    WHEN 2 THEN ' ' || (p_partkey // 1000) || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') ELSE 'part ' || p_partkey END AS v FROM part)""")
def h03(t):
    v = F.expr("CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN p_partkey || '.0' "
               "WHEN 2 THEN ' ' || (p_partkey DIV 1000) || ',' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') ELSE 'part ' || p_partkey END")
    return t("part").select("p_partkey", v.alias("v")).select("p_partkey", K.join_key(F.col("v"), STR, K.NUMERIC).alias("join_key"))


@query("h04_key_date", f"SELECT o_orderkey, {key('v', 'date')} AS join_key FROM (SELECT o_orderkey, {_DATES_SQL} AS v FROM orders)")
def h04(t):
    rows = t("orders").select("o_orderkey", F.expr(_DATES_SPARK).alias("v"))
    return rows.select("o_orderkey", K.join_key(F.col("v"), STR, K.DATE).alias("join_key"))


@query("h07_numeric_look", r"""
SELECT l_linestatus, CAST(count(*) FILTER (regexp_matches(CAST(l_extendedprice AS VARCHAR), '^\s*-?[\d,]+(\.\d+)?\s*$')) AS BIGINT) AS hits
FROM lineitem GROUP BY 1""")
def h07(t):
    text = X.value_text(F.col("l_extendedprice"), T.DoubleType())
    return t("lineitem").groupBy("l_linestatus").agg(F.count_if(X.looks_numeric(text)).alias("hits"))


@query("h08_id_prefix_look", r"""
SELECT c_mktsegment, CAST(count(*) FILTER (regexp_matches(c_name, '^[A-Za-z_#\-/]+\d+[A-Za-z0-9_\-/]*$')) AS BIGINT) AS hits FROM customer GROUP BY 1""")
def h08(t):
    return t("customer").groupBy("c_mktsegment").agg(F.count_if(X.looks_id_prefix(F.col("c_name"))).alias("hits"))


@query("h09_words_and_length", r"""
SELECT doc_id, CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0
  ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS length FROM documents""")
def h09(t):
    c = F.col("text")
    return t("documents").select("doc_id", X.word_count(c).cast("bigint").alias("words"), F.length(c).cast("bigint").alias("length"))


@query("h10_id_zero_tail", r"SELECT o_orderkey, regexp_replace(trim(' ' || o_custkey || '.0 '), '\.0+$', '') AS id FROM orders")
def h10(t):
    raw = F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0 "))
    return t("orders").select("o_orderkey", X.drop_zero_tail(raw).alias("id"))


_MESSY = "CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' || {v} || ' ' WHEN 2 THEN '1,5' WHEN 3 THEN '1e3' ELSE {v} END"


@query("h11_to_number", f"SELECT event_id, {number('v')} AS number FROM (SELECT event_id, {_MESSY.format(v='CAST(value AS VARCHAR)')} AS v FROM events)")
def h11(t):
    rows = t("events").select("event_id", F.expr(_MESSY.format(v="CAST(value AS STRING)")).alias("v"))
    return rows.select("event_id", X.to_number(F.col("v")).alias("number"))


_WORDS = "CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0.0' WHEN 4 THEN '1' WHEN 5 THEN 'maybe' ELSE 'false' END"


@query("h12_to_boolean", f"""
SELECT o_orderkey, CASE WHEN lower(w) IN ('yes', 'true', '1', '1.0') THEN 1 WHEN lower(w) IN ('no', 'false', '0', '0.0') THEN 0 END AS flag
FROM (SELECT o_orderkey, {_WORDS} AS w FROM orders)""")
def h12(t):
    return t("orders").select("o_orderkey", X.to_boolean(F.expr(_WORDS)).cast("int").alias("flag"))


# Cells in the four forms list fields come in.
_LIST = ("CASE o_orderkey % 4 WHEN 0 THEN '[''' || o_orderstatus || ''', \"' || o_orderpriority || '\"]' WHEN 1 THEN '[' || o_orderkey || ', ' || o_custkey || ']' "
         "WHEN 2 THEN '[]' ELSE o_orderpriority END")
_FIRST = "CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '[]' ELSE o_orderpriority END"
_SECOND = "CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_custkey AS VARCHAR) END"


@query("h13_list_literal", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN {_FIRST} END AS item_1, {_SECOND} AS item_2 FROM orders")
def h13(t):
    items = X.list_literal_items(F.col("v"))
    return t("orders").select("o_orderkey", F.expr(_LIST).alias("v")).select(
        "o_orderkey", F.get(items, F.lit(0)).alias("item_1"), F.get(items, F.lit(1)).alias("item_2"))


@query("h14_placeholder_clean", f"""
SELECT o_orderkey, CASE WHEN lower(trim(w)) NOT IN ({PLACEHOLDER_LIST}) THEN trim(w) END AS cleaned FROM (SELECT o_orderkey, ' ' || {_WORDS} AS w FROM orders)""")
def h14(t):
    return t("orders").select("o_orderkey", X.first_clean(F.concat(F.lit(" "), F.expr(_WORDS))).alias("cleaned"))


@query("h15_first_item", f"SELECT o_orderkey, {_FIRST} AS first_item FROM orders")
def h15(t):
    return t("orders").select("o_orderkey", X.first_item(F.expr(_LIST)).alias("first_item"))


_MULTI = "p_name || ' ; ' || p_brand || '|' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ', ' ELSE '/' END || p_name"


@query("h16_split_labels", f"""
SELECT p_partkey, CAST(pos AS BIGINT) AS pos, labels[pos] AS label FROM (
  SELECT p_partkey, labels, unnest(range(1, len(labels) + 1)) AS pos FROM (SELECT p_partkey, string_split_regex({_MULTI}, '\\s*[,;|/]\\s*') AS labels FROM part))""")
def h16(t):
    return t("part").select("p_partkey", F.posexplode(X.split_labels(F.expr(_MULTI))).alias("pos", "label")).select(
        "p_partkey", (F.col("pos") + 1).cast("bigint").alias("pos"), "label")


@query("h17_date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start FROM orders""")
def h17(t):
    o, nt = F.col("o_orderdate"), T.TimestampNTZType()
    return t("orders").select("o_orderkey", D.year_of(o, nt).cast("bigint").alias("year"), D.month_of(o, nt).cast("bigint").alias("month"),
                              D.month_start(o, nt).cast("string").alias("month_start"))


@query("h18_strip", "SELECT s_suppkey, s_name AS trimmed FROM supplier")
def h18(t):
    return t("supplier").select("s_suppkey", X.strip(F.concat(F.lit(" \t"), F.col("s_name"), F.lit("\n "))).alias("trimmed"))


@query("h19_value_hints", r"""
SELECT 'url' AS field, avg(CASE WHEN regexp_matches(trim(url), '^https?://') THEN 1.0 ELSE 0.0 END) >= 0.7 AS looks_url,
  avg(CASE WHEN regexp_full_match(trim(url), '[^@\s]+@[^@\s]+\.[^@\s]+') THEN 1.0 ELSE 0.0 END) >= 0.7 AS looks_email FROM pages""")
def h19(t):
    share = lambda h: F.avg(X.hint_match(F.col("url"), h).cast("int")) >= 0.7
    return t("pages").agg(share("url").alias("looks_url"), share("email").alias("looks_email")).select(F.lit("url").alias("field"), "looks_url", "looks_email")


_VALUES = ("CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN CAST(event_id AS {s}) WHEN 2 THEN CAST(value + 0.5 AS {s}) WHEN 3 THEN '\"' || event_type || '\"' "
           "WHEN 4 THEN 'null' ELSE '[true]' END")


@query("h20_json_value_type", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'dict' WHEN 1 THEN 'int' WHEN 2 THEN 'float' WHEN 3 THEN 'str' WHEN 4 THEN 'null' ELSE 'list' END AS type FROM events""")
def h20(t):
    return t("events").select("event_id", J.value_type(F.parse_json(F.expr(_VALUES.format(s="STRING")))).alias("type"))


@query("h21_nested_to_json", """
SELECT c_custkey, '{"n":' || c_nationkey || ',"s":["' || c_mktsegment || '"]}' AS json FROM customer""")
def h21(t):
    nested = F.struct(F.col("c_nationkey").alias("n"), F.array("c_mktsegment").alias("s"))
    return t("customer").select("c_custkey", nested.alias("x")).select("c_custkey", X.value_text(
        F.col("x"), T.StructType()).alias("json"))


@query("h22_nesting_depth", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 4 END AS depth FROM events")
def h22(t):
    doc = F.expr("CASE WHEN event_id % 2 = 0 THEN props ELSE '{\"a\": [{\"b\": ' || props || '}]}' END")
    return t("events").select("event_id", J.nesting_depth(F.parse_json(doc)).cast("int").alias("depth"))


@query("h23_grades", """
SELECT l_discount, count(*) AS n, CASE WHEN l_discount > 0.30 THEN 'critical' WHEN l_discount >= 0.05 THEN 'warning' ELSE 'ok' END AS null_grade,
  CASE WHEN l_discount > 0.10 THEN 'critical' WHEN l_discount >= 0.01 THEN 'warning' ELSE 'ok' END AS outlier_grade,
  CASE WHEN l_discount * 1000 >= 91 THEN 'excellent' WHEN l_discount * 1000 >= 71 THEN 'good' WHEN l_discount * 1000 >= 41 THEN 'fair' ELSE 'poor' END AS quality_grade,
  CASE WHEN l_discount * 10 > 0.95 THEN 'severe' WHEN l_discount * 10 >= 0.85 THEN 'high' ELSE 'ok' END AS correlation_grade,
  CASE WHEN l_discount * 110 > 10 THEN 'severe' WHEN l_discount * 110 >= 3 THEN 'moderate' ELSE 'balanced' END AS imbalance_grade
FROM lineitem GROUP BY l_discount""")
def h23(t):
    d = F.col("l_discount")
    return t("lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n")).select(
        "l_discount", "n", G.null_grade(d).alias("null_grade"), G.outlier_grade(d).alias("outlier_grade"),
        G.quality_grade(d * 1000).alias("quality_grade"), G.correlation_grade(d * 10).alias("correlation_grade"),
        G.imbalance_grade(d * 110).alias("imbalance_grade"))


@query("h24_stable_token", """
SELECT count(*) AS tokens, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)""")
def h24(t):
    # the same two entries in either order are one token
    a, b = (F.lit("n"), F.col("c_nationkey").cast("string")), (F.lit("s"), F.col("c_mktsegment"))
    m = F.when(F.col("c_custkey") % 2 == 0, F.create_map(*a, *b)).otherwise(F.create_map(*b, *a))
    token = X.stable_token(m, T.MapType(STR, STR))
    return t("customer").groupBy(token.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("rows"))


@query("h25_json_field_profile", """
SELECT 'k' AS path, 'number' AS kind, count(*) AS count, CAST(0 AS BIGINT) AS null_count, count(*) AS n_int,
  count(DISTINCT json_extract(props, '$.k')) AS n_unique FROM events""", spread=True)
def h25(t):
    fields = J.field_profile(t("events").select(F.parse_json("props").alias("record")))
    return fields.select("path", "kind", "count", "null_count", "n_int", "n_unique")


_NESTED_DOC = ("'{\"id\": ' || o_orderkey || ', \"who\": {\"cust\": ' || o_custkey || ', \"note\": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '\"x\"' END || '}, "
               "\"lines\": [{\"s\": \"' || o_orderstatus || '\"}, {\"s\": \"Z\"}], \"tags\": [1, \"a\"], \"none\": [], \"mix\": ' || CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '{}' END || '}'")


@query("h25b_json_nested_profile", """
SELECT 'id' AS path, 'number' AS kind, count(*) AS count, CAST(0 AS BIGINT) AS null_count, count(DISTINCT o_orderkey) AS n_unique, 0 AS array_depth, false AS is_nested FROM orders
UNION ALL SELECT 'mix', 'mixed', count(*), 0, 1, 0, true FROM orders
UNION ALL SELECT 'none', 'null', count(*), count(*), 0, 0, false FROM orders
UNION ALL SELECT 'tags', 'string', count(*), 0, 1, 0, false FROM orders
UNION ALL SELECT 'who.cust', 'number', count(*), 0, count(DISTINCT o_custkey), 0, false FROM orders
UNION ALL SELECT 'who.note', 'string', count(*), count(*) FILTER (o_orderkey % 3 = 0), 1, 0, false FROM orders
UNION ALL SELECT 'lines[*].s', 'string', 2 * count(*), 0, count(DISTINCT o_orderstatus) + 1, 1, true FROM orders""", spread=True)
def h25b(t):
    fields = J.field_profile(t("orders").select(F.parse_json(F.expr(_NESTED_DOC)).alias("record")))
    return fields.select("path", "kind", "count", "null_count", "n_unique", "array_depth", "is_nested")


@query("h26_structural_warnings", """
SELECT DISTINCT 7 AS total_fields, 2 AS nested_fields, 1 AS mixed_fields, 1 AS high_null_fields, 3 AS max_depth, false AS deep_nesting FROM orders""", spread=True)
def h26(t):
    return J.structural_warnings(t("orders").select(F.parse_json(F.expr(_NESTED_DOC)).alias("record")))


@query("h25c_json_field_samples", """
WITH s AS (SELECT 'id' AS path, CAST(o_orderkey AS VARCHAR) AS text FROM orders UNION ALL SELECT 'who.cust', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'lines[*].s', unnest([o_orderstatus, 'Z']) FROM orders UNION ALL SELECT 'who.note', 'x' FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT 'tags', '[1,"a"]' FROM orders UNION ALL SELECT 'mix', CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '{}' END FROM orders),
c AS (SELECT path, text, count(*) AS n FROM s GROUP BY path, text)
SELECT path, text, n FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, text) <= 3""", spread=True)
def h25c(t):
    """Example values of every field, most frequent first."""
    return J.field_samples(t("orders").select(F.parse_json(F.expr(_NESTED_DOC)).alias("record")), 3).select("path", "text", "n")


_ODD_DOC = """CASE o_orderkey % 5 WHEN 0 THEN '{"p": [{"a": 1}], "q": [{"a": 1}, {"a": ' || o_orderkey || '}]}' WHEN 1 THEN '[]' WHEN 2 THEN '{oops ' || o_orderkey
  WHEN 3 THEN '{"a": 1}' || chr(10) || '{"a": ' || o_orderkey || '}' || chr(10) || '{"a"' ELSE '{"a": ' || o_orderkey || '}' END"""


@query("h26b_document_warnings", """
SELECT o_orderkey AS doc, CASE o_orderkey % 5 WHEN 0 THEN 'several arrays, only the largest is used: p, q' WHEN 1 THEN 'empty document'
  WHEN 2 THEN 'unknown layout: no JSON document and no JSON lines' ELSE '1 lines are no JSON records' END AS warning FROM orders WHERE o_orderkey % 5 < 4""", spread=True)
def h26b(t):
    return J.document_warnings(t("orders").select(F.col("o_orderkey").alias("doc"), F.expr(_ODD_DOC).alias("text")))


_RENAMED = {"o_orderkey": " Order Key ", "o_custkey": "Cust--Key", "o_orderstatus": "1st Status", "o_totalprice": "order key", "o_orderdate": "***",
            "o_orderpriority": "Priority.Level"}


@query("p01_normalize_columns", """
SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS col_1st_status, o_totalprice AS order_key_1,
  strftime(o_orderdate, '%Y-%m-%d') AS unnamed, o_orderpriority AS priority_level FROM orders""")
def p01(t):
    return N.rename_clean(t("orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).toDF(*_RENAMED.values()))


@query("p02_json_column_names", "SELECT n_nationkey AS key__id, n_name AS name_text FROM nation")
def p02(t):
    return N.rename_json(t("nation").select(F.col("n_nationkey").alias("key.id"), F.col("n_name").alias("name text")))


@query("p03_incident_column_names", "SELECT n_nationkey AS incident_id, n_name AS harm_type FROM nation")
def p03(t):
    return N.rename_incident(t("nation").select(F.col("n_nationkey").alias(" Incident ID "), F.col("n_name").alias("Harm.Type")))


@query("p04_header_match", "SELECT c_custkey, c_mktsegment AS first_match, c_name AS second_match FROM customer")
def p04(t):
    df = t("customer").select("c_custkey", F.col("c_mktsegment").alias("Harm Type"), F.col("c_name").alias("harm_type.1"))
    a, b = N.columns_matching(df.columns, "HARM-TYPE")
    return df.select("c_custkey", F.col(f"`{a}`").alias("first_match"), F.col(f"`{b}`").alias("second_match"))


@query("p05_pick_column", "SELECT c_custkey AS picked FROM customer")
def p05(t):
    df = t("customer")
    return df.select(F.col(N.pick_column(df.columns, ["missing", "C_CUSTKEY", "c_name"])).alias("picked"))


@query("p06_fuzzy_column", "SELECT o_orderpriority AS picked FROM orders")
def p06(t):
    df = t("orders")
    return df.select(F.col(N.fuzzy_column(df.columns, ["order_priority", "status"])).alias("picked"))
