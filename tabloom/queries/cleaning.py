"""Cleaning steps over events and orders with holes, copies and odd spellings put in by expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import encoders as E
from ..operators.aggregates import duplicate_rows
from .aggregates import _EVENTS_WITH_HOLES, _fence_sql, holes
from .registry import query
from .sqltext import union


@query("c01_column_normaliser", "SELECT DISTINCT 'Order Key' AS before, 'order_key' AS after FROM orders UNION ALL SELECT DISTINCT '2nd-Key', 'col_2nd_key' FROM orders")
def c01(t):
    df = t("orders").withColumnsRenamed({"o_orderkey": "Order Key", "o_custkey": "2nd-Key"})
    logs = C.normalize_columns(df, C.Context()).log_frame()
    return logs.select(F.col("column_name").alias("before"), F.get_json_object("after_value", "$.new_name").alias("after"))


@query("c02_role_inference", """
WITH n AS (SELECT count(*) AS rows FROM documents)
SELECT 'doc_id' AS "column", 'id_col' AS role FROM n
UNION ALL SELECT 'text', CASE WHEN count(DISTINCT text) / count(*) > 0.95 THEN 'feature_col' WHEN avg(length(text)) > 50 THEN 'text_col' ELSE 'feature_col' END FROM documents
UNION ALL SELECT 'lang', 'feature_col' FROM n UNION ALL SELECT 'source', 'feature_col' FROM n
UNION ALL SELECT 'n_chars', CASE WHEN count(DISTINCT n_chars) / count(*) > 0.95 THEN 'id_col' ELSE 'feature_col' END FROM documents""", spread=True)
def c02(t):
    df = t("documents")
    result = C.infer_roles(df, C.Context())
    return result.log_frame().select(F.col("column_name").alias("column"), F.get_json_object("after_value", "$.role").alias("role"))


@query("c02b_role_figures", union([
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS n_distinct, {share} AS date_share, {length} AS mean_length FROM orders"
    for c, share, length in (("o_orderkey", "NULL", "NULL"), ("o_orderdate", "1.0", "10.0"), ("o_orderpriority", "0.0", "round(avg(length(o_orderpriority)), 6)"))]))
def c02b(t):
    padded = t("orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate"), "o_orderpriority")
    return C.role_figures(padded).withColumn("mean_length", F.round("mean_length", 6))


_TYPED = {
    "mostly": "CASE WHEN event_id % 50 = 0 THEN 'oops' ELSE ' ' || CAST(user_id AS {s}) || ' ' END",
    "always": "CAST(user_id AS {s})",
    "answer": "CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'no' END",
}


@query("c03_type_fixer", """
SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN CAST(user_id AS DOUBLE) END AS mostly, CAST(user_id AS VARCHAR) AS always, event_id % 2 = 0 AS answer FROM events""")
def c03(t):
    df = t("events").select("event_id", *[F.expr(e.format(s="STRING")).alias(c) for c, e in _TYPED.items()])
    return C.fix_types(df, C.Context()).df


@query("c03b_type_figures", union([f"SELECT '{c}' AS \"column\", count(*) AS n, round(avg(CASE WHEN {n} THEN 1.0 ELSE 0.0 END), 9) AS numeric_share, {b} AS boolean_share FROM events" for c, n, b in (
    ("mostly", "event_id % 50 <> 0", "round(avg(CASE WHEN event_id % 50 <> 0 AND user_id IN (0, 1) THEN 1.0 ELSE 0.0 END), 9)"),
    ("always", "true", "round(avg(CASE WHEN user_id IN (0, 1) THEN 1.0 ELSE 0.0 END), 9)"), ("answer", "false", "1.0"))]))
def c03b(t):
    df = t("events").select(*[F.expr(e.format(s="STRING")).alias(c) for c, e in _TYPED.items()])
    return C.type_figures(df).select("column", "n", F.round("numeric_share", 9).alias("numeric_share"), F.round("boolean_share", 9).alias("boolean_share"))


@query("c04_missing_values", """
WITH h AS (SELECT event_id, ts, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 30 = 0 THEN NULL ELSE ts END AS seen FROM events),
f AS (SELECT quantile_cont(value, 0.5) AS value, (SELECT event_type FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS event_type FROM h)
SELECT h.event_id, coalesce(h.event_type, f.event_type) AS event_type, round(coalesce(h.value, f.value), 6) AS value, h.user_id,
  strftime(last_value(seen IGNORE NULLS) OVER (ORDER BY h.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '%Y-%m-%d %H:%M:%S') AS seen,
  CASE WHEN h.event_type IS NULL THEN 1 ELSE 0 END AS event_type_was_missing, CASE WHEN h.value IS NULL THEN 1 ELSE 0 END AS value_was_missing FROM h, f""", spread=True)
def c04(t):
    """More than 30 % of user_id is missing, so that column is left alone."""
    df = holes(t).join(t("events").select(F.col("event_id").alias("_e"), F.expr("CASE WHEN event_id % 30 = 0 THEN NULL ELSE ts END").alias("seen")), F.col("event_id") == F.col("_e")).drop("_e")
    out = C.fill_missing(df, C.Context(roles={"event_id": "id_col"}, order_by=("event_id",))).df
    return out.withColumn("value", F.round("value", 6)).withColumn("seen", F.date_format("seen", "yyyy-MM-dd HH:mm:ss"))


@query("c05_duplicate_rows", """
SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT role, text FROM conversations)) AS duplicates FROM conversations""")
def c05(t):
    return duplicate_rows(t("conversations").select("role", "text")).select("rows", "duplicates")


@query("c06_outliers", f"""
SELECT "column", 'IQR' AS method, outlier_count, round(outlier_count / (SELECT count(*) FROM events), 4) AS outlier_pct FROM ({_fence_sql('events', ['value', 'user_id'])})""", spread=True)
def c06(t):
    return C.outlier_figures(t("events"), ["value", "user_id"]).select("column", "method", "outlier_count", "outlier_pct")


@query("c06c_outliers_by_z_score", """
WITH x AS (SELECT sqrt(-2 * ln(((o_orderkey * 7919) % 10007 + 0.5) / 10007)) * cos(2 * pi() * ((o_orderkey * 104729) % 10009 + 0.5) / 10009) AS v FROM orders),
m AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd, count(*) AS n FROM x)
SELECT 'v' AS "column", 'Z-Score' AS method, count(*) FILTER (abs((v - mu) / sd) > 3.5) AS outlier_count, round(count(*) FILTER (abs((v - mu) / sd) > 3.5) / any_value(n), 4) AS outlier_pct FROM x, m""", spread=True)
def c06c(t):
    """A bell curve made from the order keys, so that the normality test takes the z-score branch."""
    bell = "sqrt(-2 * ln(((o_orderkey * 7919) % 10007 + 0.5D) / 10007)) * cos(2 * pi() * ((o_orderkey * 104729) % 10009 + 0.5D) / 10009) AS v"
    return C.outlier_figures(t("orders").selectExpr(bell), ["v"]).select("column", "method", "outlier_count", "outlier_pct")


@query("c06b_normality_figures", """
WITH m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x) AS mu FROM (SELECT l_extendedprice AS x FROM lineitem)),
c AS (SELECT any_value(n) AS n, avg(pow(l_extendedprice - mu, 3)) / pow(avg(pow(l_extendedprice - mu, 2)), 1.5) AS g1, avg(pow(l_extendedprice - mu, 4)) / pow(avg(pow(l_extendedprice - mu, 2)), 2) AS b2 FROM lineitem, m),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS bb FROM c),
w AS (SELECT *, sqrt(2 * (bb - 1)) - 1 AS w2 FROM s),
k AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sk FROM w),
a AS (SELECT *, 6 + 8 / sk * (2 / sk + sqrt(1 + 4 / (sk * sk))) AS a FROM k), d AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS d FROM a)
SELECT round(z1, 4) AS z1, round((1 - 2 / (9 * a) - sign(d) * pow((1 - 2 / a) / abs(d), 1.0 / 3)) / sqrt(2 / (9 * a)), 4) AS z2 FROM d""")
def c06b(t):
    m = t("lineitem").agg(F.count("l_extendedprice").cast("double").alias("n"), F.skewness("l_extendedprice").alias("g1"), F.kurtosis("l_extendedprice").alias("g2"))
    return m.select(F.round(C.skew_z(F.col("n"), F.col("g1")), 4).alias("z1"), F.round(C.kurtosis_z(F.col("n"), F.col("g2") + 3), 4).alias("z2"))


@query("c07_encoder_suggestions", """
SELECT DISTINCT 'p_type' AS "column", 'One-Hot Encoding' AS suggestion FROM part UNION ALL SELECT DISTINCT 'p_brand', 'Label/Ordinal Encoding' FROM part
UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) <= 10 THEN 'One-Hot Encoding' WHEN count(DISTINCT p_name) <= 50 THEN 'Label/Ordinal Encoding' ELSE 'Target/Frequency Encoding' END FROM part""")
def c07(t):
    df = t("part")
    return C.encoder_suggestions(df, {"p_partkey": "id_col"})


@query("c07b_encode_suggested", """
WITH p AS (SELECT *, p_partkey % 5 AS fold FROM part), g AS (SELECT sum(p_retailprice) AS t, count(*) AS n FROM p),
gf AS (SELECT fold, sum(p_retailprice) AS t, count(*) AS n FROM p GROUP BY 1), v AS (SELECT p_name, sum(p_retailprice) AS t, count(*) AS n FROM p GROUP BY 1),
vf AS (SELECT p_name, fold, sum(p_retailprice) AS t, count(*) AS n FROM p GROUP BY 1, 2), kinds AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM p)),
brands AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM p))
SELECT p_partkey, """ + ", ".join(f"CAST(kinds.k = {k} AS INT) AS p_type_is_{k}" for k in range(6)) + """, CAST(brands.k AS INT) AS p_brand_code,
  round((v.t - vf.t + 10 * (g.t - gf.t) / (g.n - gf.n)) / (v.n - vf.n + 10), 6) AS p_name_target
FROM p, g JOIN gf ON true JOIN v ON true JOIN vf ON true JOIN kinds ON true JOIN brands ON true
WHERE gf.fold = p.fold AND v.p_name = p.p_name AND vf.p_name = p.p_name AND vf.fold = p.fold AND kinds.p_type = p.p_type AND brands.p_brand = p.p_brand""", spread=True)
def c07b(t):
    """What c07 suggests, fitted and applied: the target mean of a row's name leaves out the row's own fold."""
    df, fold = t("part").select("p_partkey", "p_type", "p_brand", "p_name", "p_retailprice"), F.pmod("p_partkey", F.lit(5))
    plan = E.plan_encoders(df, {"p_partkey": "id_col", "p_retailprice": "target_col"}, target="p_retailprice")
    coded = E.fit_encoders(df, plan, "p_retailprice", fold, 5).transform(df, fold)
    return coded.drop("p_type", "p_brand", "p_name", "p_retailprice").withColumn("p_name_target", F.round("p_name_target", 6))


@query("c07c_encode_frequency", """
WITH v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE round(v.n / g.n, 9) END AS o_custkey_share, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
  day(o_orderdate) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INT) AS o_orderdate_weekday, CAST(isodow(o_orderdate) > 5 AS INT) AS o_orderdate_is_weekend
FROM orders JOIN v USING (o_custkey), g""", spread=True)
def c07c(t):
    """Fitted on all orders, applied to rows of which a third hold a customer never seen."""
    df = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"))
    fitted = E.fit_encoders(df, {"o_custkey": "frequency", "o_orderdate": "date_parts"})
    coded = fitted.transform(df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))))
    return coded.drop("o_custkey", "o_orderdate").withColumn("o_custkey_share", F.round("o_custkey_share", 9))


@query("c08_domain_rules", """SELECT 'exam_score' AS "column", 'outside_0_100' AS rule, count(*) AS rows FROM part WHERE p_retailprice / 10 > 100 HAVING count(*) > 0""")
def c08(t):
    from ..operators.rows import domain_anomalies

    return domain_anomalies(t("part").select((F.col("p_retailprice") / 10).alias("exam_score")), "education").select("column", "rule", "rows")


@query("c09_clean_all", f"""
WITH h AS ({_EVENTS_WITH_HOLES}), f AS (SELECT quantile_cont(value, 0.5) AS value, (SELECT event_type FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS event_type FROM h)
SELECT h.event_id, coalesce(h.event_type, f.event_type) AS event_type, round(coalesce(h.value, f.value), 6) AS value_x, h.user_id,
  CASE WHEN h.event_type IS NULL THEN 1 ELSE 0 END AS event_type_was_missing, CASE WHEN h.value IS NULL THEN 1 ELSE 0 END AS value_x_was_missing FROM h, f""", spread=True)
def c09(t):
    df = holes(t).withColumnRenamed("value", "Value X")
    return C.clean(df, C.Context(order_by=("event_id",))).df.withColumn("value_x", F.round("value_x", 6))


@query("c09b_clean_log", """
SELECT DISTINCT 'flag_duplicates' AS action, CAST(NULL AS VARCHAR) AS column_name, 'warning' AS severity FROM lineitem
UNION ALL SELECT DISTINCT 'rename_column', 'Line Flag', 'info' FROM lineitem
UNION ALL SELECT DISTINCT 'suggest_encoder', 'line_flag', 'info' FROM lineitem
UNION ALL SELECT DISTINCT 'role_assignment', 'line_flag', 'info' FROM lineitem
UNION ALL SELECT DISTINCT 'role_assignment', 'l_quantity', 'info' FROM lineitem""", spread=True)
def c09b(t):
    df = t("lineitem").select(F.col("l_returnflag").alias("Line Flag"), "l_quantity")
    return C.clean(df).log_frame().select("action", "column_name", "severity")
