"""Aggregations and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..operators import aggregates as A, profile as P, quantiles as Q
from ..operators.shape import melt_numbers
from ..plans import analyses as N
from .registry import query
from .sqltext import even, number, union

_PRIORITY = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a01_group_count", f"SELECT {_PRIORITY} AS priority, count(*) AS count FROM orders GROUP BY 1")
def a01(t):
    return A.group_count(t("orders").select(F.expr(_PRIORITY).alias("priority")), "priority")


@query("a02_two_key_count", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def a02(t):
    return A.group_count(t("lineitem"), "l_returnflag", "l_linestatus")


@query("a03_value_counts", f"""
WITH c AS (SELECT {_PRIORITY} AS priority, count(*) AS count FROM orders GROUP BY 1), s AS (SELECT sum(count) FILTER (priority IS NOT NULL) AS total FROM c)
SELECT priority, count, {even('count * 100.0 / total', 1)} AS percentage FROM c, s ORDER BY count DESC, priority NULLS LAST LIMIT 4""")
def a03(t):
    return A.value_counts(t("orders").select(F.expr(_PRIORITY).alias("priority")), "priority", 4)


@query("a04_top_values", f"""
WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS count FROM orders GROUP BY 1)
SELECT value, count, {even('count * 100.0 / (SELECT count(*) FROM orders)', 1)} AS percentage FROM c ORDER BY count DESC, value LIMIT 5""")
def a04(t):
    return A.top_values(t("orders"), "o_custkey", 5)


@query("a05_grouped_sum", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20")
def a05(t):
    return A.grouped_metric(t("orders"), "o_custkey", "o_totalprice", "sum", 20).select("o_custkey", F.round("o_totalprice", 2).alias("total"))


@query("a05b_grouped_mean", f"""
SELECT event_type, round(avg({number('v')}), 6) AS v FROM (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS v FROM events) GROUP BY 1""")
def a05b(t):
    df = t("events").select("event_type", F.expr("CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE CAST(value AS STRING) END").alias("v"))
    return A.grouped_metric(df, "event_type", "v", "mean").select("event_type", F.round("v", 6).alias("v"))


@query("a05c_grouped_median", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice FROM lineitem GROUP BY 1")
def a05c(t):
    return A.grouped_metric(t("lineitem"), "l_returnflag", "l_extendedprice", "median").withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("a05d_grouped_median_by_selection", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY 1", spread=True)
def a05d(t):
    """The plan for groups too large for a value map: bracket by sketch, then count inside the bracket."""
    return Q.grouped_median(t("lineitem"), "l_suppkey", "l_extendedprice").withColumn("median", F.round("median", 6))


@query("a06_distinct_counts", union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in (
    "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")]), spread=True)
def a06(t):
    return A.distinct_counts(t("lineitem"), ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"])


@query("a06b_approx_distinct")
def a06b(t):
    return A.distinct_counts(t("lineitem"), approx=True)


@query("a06d_approx_distinct_error", """SELECT 'l_orderkey' AS "column", true AS near FROM lineitem UNION SELECT 'l_partkey', true FROM lineitem UNION SELECT 'l_shipdate', true FROM lineitem UNION SELECT 'l_returnflag', true FROM lineitem""")
def a06d(t):
    """The sketch is within a fifth of the exact count."""
    df = t("lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    near, exact = A.distinct_counts(df, approx=True).withColumnRenamed("n_distinct", "near"), A.distinct_counts(df)
    return exact.join(near, "column").select("column", (F.abs(F.col("near") - F.col("n_distinct")) <= 0.2 * F.col("n_distinct")).alias("near"))


@query("a07_numeric_moments", union([
    f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem" for c in _NUMBERS]), spread=True)
def a07(t):
    m = A.numeric_moments(t("lineitem"), _NUMBERS)
    return m.select("column", "n", "min", "max", F.round("mean", 7).alias("mean"), F.round("std", 4).alias("std"),
                    F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


def _fence_sql(table: str, columns: list[str]) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, (SELECT count(*) FROM {table} "
        f"WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS outlier_count FROM (SELECT quantile_cont({c}, 0.25) AS q1, "
        f"quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {table})" for c in columns])


@query("a08_fence_outliers", _fence_sql("events", ["value", "user_id"]))
def a08(t):
    o = P.fence_outliers(t("events"), ["value", "user_id"])
    return o.select("column", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "outlier_count")


@query("a08b_quantiles_by_selection", union([
    f"SELECT '{c}' AS \"column\", {p} AS prob, round(quantile_cont({c}, {p}), 6) AS quantile FROM lineitem" for c in _NUMBERS for p in (0.25, 0.5, 0.75)]), spread=True)
def a08b(t):
    q = Q.bracketed_quantiles(melt_numbers(t("lineitem"), _NUMBERS), "column", "value", [0.25, 0.5, 0.75])
    return q.withColumn("quantile", F.round("quantile", 6))


_HOLES = {"event_type": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END", "value": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END",
          "user_id": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END"}
_EVENTS_WITH_HOLES = "SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in _HOLES.items()) + " FROM events"


def holes(t):
    return t("events").select("event_id", *[F.expr(e).alias(c) for c, e in _HOLES.items()])


@query("a09_null_counts", union([
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, round(count(*) FILTER ({c} IS NULL) / count(*), 9) AS null_pct FROM ({_EVENTS_WITH_HOLES})"
    for c in ("event_id", *_HOLES)]))
def a09(t):
    return A.null_counts(holes(t)).withColumn("null_pct", F.round("null_pct", 9))


@query("a10_mode", union([
    f"SELECT '{c}' AS \"column\", (SELECT CAST({c} AS VARCHAR) FROM orders GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS mode"
    for c in ("o_custkey", "o_orderstatus", "o_orderpriority")]))
def a10(t):
    return A.modes(t("orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("a11_median", "SELECT round(quantile_cont(value, 0.5), 6) AS median FROM events WHERE event_id % 17 <> 0")
def a11(t):
    return Q.column_quantiles(holes(t), ["value"], [0.5]).select(F.round("quantile", 6).alias("median"))


_CELLS = "SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders GROUP BY 1, 2"


@query("a12_crosstab", _CELLS)
def a12(t):
    return A.crosstab(t("orders"), "o_orderpriority", "o_orderstatus")


@query("a12b_label_pairs", """
WITH x AS (SELECT [p_type, p_brand] AS a, [p_name, CAST(p_size AS VARCHAR)] AS b FROM part), y AS (SELECT unnest(a) AS a, b FROM x), z AS (SELECT a, unnest(b) AS b FROM y)
SELECT a, b, count(*) AS count FROM z GROUP BY 1, 2""")
def a12b(t):
    df = t("part").select(F.concat_ws("; ", "p_type", "p_brand").alias("a"), F.concat_ws(" | ", "p_name", "p_size").alias("b"))
    return A.group_count(A.label_pairs(df, "a", "b"), "a", "b")


@query("a13_strongest_cell", f"SELECT * FROM ({_CELLS}) ORDER BY count DESC, 1, 2 LIMIT 1")
def a13(t):
    return A.strongest_cell(A.crosstab(t("orders"), "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus")


@query("a14_correlation_pair", """
SELECT 'value' AS x_field, 'user_id' AS y_field, round(corr(value, user_id), 9) AS value, count(*) AS sample_size
FROM events WHERE event_id % 17 <> 0 AND event_id % 3 <> 0""")
def a14(t):
    return A.correlation_pair(holes(t), "value", "user_id").withColumn("value", F.round("value", 9))


@query("a15_correlation_matrix", union([
    f"SELECT '{a}' AS col1, '{b}' AS col2, {'1.0' if a == b else f'round(corr({a}, {b}), 9)'} AS r FROM lineitem" + (" LIMIT 1" if a == b else "")
    for a in _NUMBERS for b in _NUMBERS]).replace("FROM lineitem LIMIT 1", ""))
def a15(t):
    return A.correlation_matrix(t("lineitem"), _NUMBERS).withColumn("r", F.round("r", 9))


@query("a16_high_correlations", "SELECT 'p_partkey' AS col1, 'twice' AS col2, round(corr(p_partkey, p_partkey * 2 + p_size), 6) AS correlation FROM part")
def a16(t):
    df = t("part").withColumn("twice", F.col("p_partkey") * 2 + F.col("p_size"))
    return A.high_correlations(df, ["p_partkey", "p_size", "twice"]).withColumn("correlation", F.round("correlation", 6))


@query("a15b_correlation_with_holes", """
WITH h AS (SELECT CASE WHEN l_orderkey % 3 > 0 THEN l_quantity END AS q, CASE WHEN l_partkey % 5 > 0 THEN l_extendedprice + 1e9 END AS p, CASE WHEN l_suppkey % 2 > 0 THEN l_discount END AS d,
  5.0 AS constant, CASE WHEN l_suppkey % 2 = 0 THEN l_tax END AS other FROM lineitem)
""" + union([f"SELECT '{a}' AS col1, '{b}' AS col2, round({'NULL' if 'constant' in (a, b) or (a, b) == ('d', 'other') else f'corr({a}, {b})'}, 6) AS r FROM h"
             + (" LIMIT 1" if 'constant' in (a, b) or (a, b) == ('d', 'other') else "") for i, a in enumerate(["q", "p", "d", "constant", "other"]) for b in ["q", "p", "d", "constant", "other"][i + 1:]]).replace("FROM h LIMIT 1", ""))
def a15b(t):
    """Pairwise-complete: columns with different holes, one far from zero, one constant, and two that no row has both of."""
    h = t("lineitem").selectExpr("CASE WHEN l_orderkey % 3 > 0 THEN l_quantity END AS q", "CASE WHEN l_partkey % 5 > 0 THEN l_extendedprice + 1e9 END AS p",
                                 "CASE WHEN l_suppkey % 2 > 0 THEN l_discount END AS d", "5.0D AS constant", "CASE WHEN l_suppkey % 2 = 0 THEN l_tax END AS other")
    return A.correlation_pairs(h).withColumn("r", F.round("r", 6))


@query("a17_duplicate_rows", """
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n - 1) / sum(n), 9) AS duplicate_pct
FROM (SELECT *, count(*) AS n FROM (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL)""")
def a17(t):
    df = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    both = df.drop("l_returnflag").unionAll(df.where("l_returnflag = 'R'").drop("l_returnflag"))
    return A.duplicate_rows(both).withColumn("duplicate_pct", F.round("duplicate_pct", 9))


@query("a17b_text_duplicates", "SELECT count(*) AS rows, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def a17b(t):
    return A.duplicate_rows(t("documents").select("text")).select("rows", "duplicates")


@query("a18_class_balance", union([f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM orders GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority")]))
def a18(t):
    return P.class_balance(t("orders"))


_TOP5 = union([f"(SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2)" for c in ("p_name", "p_brand", "p_type", "p_size", "p_partkey")])


@query("a19_top_column_values", f"""
SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM ({_TOP5})) WHERE r <= 5""")
def a19(t):
    return P.top_column_values(t("part"), 5, ["p_name", "p_brand", "p_type", "p_size", "p_partkey"]).drop("rank")


def _profile_sql(table: str, numbers: list[str], texts: list[str]) -> str:
    """Column profile of a table without text roles."""
    parts = []
    for c in numbers:
        parts.append(f"""SELECT '{c}' AS "column", 0.0 AS null_pct, u AS unique_count, CASE WHEN sk > 1 THEN 'right_skewed' WHEN sk < -1 THEN 'left_skewed' WHEN u < 10 THEN 'categorical' ELSE 'normal' END AS distribution_type,
  (SELECT count(*) FROM {table} WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS outlier_count, round(mean, 6) AS mean, round(q2, 6) AS median
  FROM (SELECT count(DISTINCT {c}) AS u, skewness({c}) AS sk, avg({c}) AS mean, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {table})""")
    for c in texts:
        parts.append(f"SELECT '{c}', 0.0, count(DISTINCT {c}), 'categorical', 0, NULL, NULL FROM {table}")
    return union(parts)


@query("a20_potential_targets", union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM lineitem HAVING count(DISTINCT {c}) BETWEEN 2 AND 20" for c in (
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]), spread=True)
def a20(t):
    return P.target_columns(t("lineitem"), {"l_orderkey": "id_col"})


@query("a21_quality_score", """
WITH q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(v) AS n FROM (SELECT CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events)),
o AS (SELECT count(*) AS n FROM events, q WHERE event_id % 17 <> 0 AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)))
SELECT round(greatest(0.0, 100 - 50 * ((SELECT count(*) FILTER (event_id % 10 = 0) + count(*) FILTER (event_id % 17 = 0) + count(*) FILTER (event_id % 3 = 0) FROM events) / (SELECT count(*) FROM events))
  - least(10.0, 100 * (SELECT n FROM o) / (SELECT n FROM q))), 1) AS quality_score""", spread=True)
def a21(t):
    return P.quality_score(P.column_profile(holes(t)))


@query("a22_column_profile", _profile_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]), spread=True)
def a22(t):
    p = P.column_profile(t("part"))
    return p.select("column", "null_pct", "unique_count", "distribution_type", "outlier_count", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("a22b_dataset_summary", """
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS cols, 100.0 AS quality_score, false AS time_series_detected, 'p_type' AS potential_target_columns FROM part""", spread=True)
def a22b(t):
    return P.dataset_summary(t("part"), {"p_brand": "id_col", "p_name": "id_col", "p_size": "id_col"}).select(
        "rows", "cols", "quality_score", "time_series_detected", "potential_target_columns")


@query("a23_date_range", "SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders WHERE o_orderkey % 4 <> 0")
def a23(t):
    df = t("orders").select(F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE 'unknown' END").alias("d"))
    r = A.date_range(df, "d")
    return r.select(*[F.col(c).cast("date").cast("string").alias(c) for c in ("earliest", "latest")])


@query("a24_coverage", union([f"SELECT '{c}' AS field, round(100.0 * count({c}) / count(*), 1) AS coverage_pct FROM ({_EVENTS_WITH_HOLES})" for c in _HOLES]))
def a24(t):
    return A.coverage(holes(t), list(_HOLES))


@query("a25_yearly_counts", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS count FROM orders GROUP BY 1")
def a25(t):
    df = t("orders").select(F.year("o_orderdate").cast("string").alias("y"))
    return A.yearly_counts(df, "y").withColumn("year", F.col("year").cast("bigint"))


@query("a26_join_unique", """
SELECT l_orderkey, string_agg(l_returnflag, ', ' ORDER BY first_line, l_returnflag) AS flags
FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first_line FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT l_orderkey, NULL FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'N')""", spread=True)
def a26(t):
    # line numbers repeat within an order, so the flag itself is the second order key
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE l_returnflag END").alias("f"))
    return A.join_unique(df, ["l_orderkey"], "f", ["l_linenumber", "f"], "flags")


@query("a27_first_by_priority", """
SELECT l_orderkey, min_by(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) FILTER (l_returnflag <> 'N') AS flag FROM lineitem GROUP BY 1""")
def a27(t):
    value = F.expr("CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END")
    return t("lineitem").groupBy("l_orderkey").agg(A.first_by_priority(value, F.col("l_linenumber"), F.col("l_partkey")).alias("flag"))


@query("a28_latest_date", "SELECT l_orderkey, strftime(max(l_shipdate), '%Y-%m-%d') AS latest FROM lineitem GROUP BY 1")
def a28(t):
    return (
        t("lineitem").groupBy("l_orderkey").agg(A.latest_date(F.col("l_shipdate"), T.TimestampNTZType()).alias("latest")))


@query("a29_multi_aggregate", """
WITH k AS (SELECT l_suppkey AS k, string_agg(l_returnflag, ', ' ORDER BY l_returnflag) AS flags FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) GROUP BY 1)
SELECT l_suppkey, flags, (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem l WHERE l.l_suppkey = k.k) AS latest FROM k JOIN (SELECT DISTINCT l_suppkey FROM lineitem) ON l_suppkey = k""")
def a29(t):
    df = t("lineitem")
    flags = A.join_unique(df, ["l_suppkey"], "l_returnflag", ["l_returnflag"], "flags")
    return flags.join(df.groupBy("l_suppkey").agg(A.latest_date(F.col("l_shipdate"), T.TimestampNTZType()).alias("latest")), "l_suppkey")


_LABELS = "SELECT unnest([p_type, p_brand, p_name]) AS label FROM part"


@query("a30_label_counts", f"""
WITH c AS (SELECT label, count(*) AS count FROM ({_LABELS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)
SELECT label, count, {even('count * 100.0 / (SELECT sum(count) FROM c)', 1)} AS pct FROM c""")
def a30(t):
    return A.label_counts(t("part").select(F.concat_ws(" / ", "p_type", "p_brand", "p_name").alias("x")), "x", 12)


@query("a31_histogram", union([f"""
SELECT '{c}' AS "column", least(CAST(floor((v - lo) / (hi - lo) * 30) AS INTEGER), 29) AS bin, count(*) AS count
FROM (SELECT CAST({c} AS DOUBLE) AS v, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM lineitem) GROUP BY 2""" for c in ("l_quantity", "l_extendedprice")]))
def a31(t):
    return A.histogram(t("lineitem"), ["l_quantity", "l_extendedprice"]).select("column", "bin", "count")


@query("a32_null_patterns", f"""
SELECT concat(CASE WHEN event_type IS NULL THEN '1' ELSE '0' END, CASE WHEN value IS NULL THEN '1' ELSE '0' END, CASE WHEN user_id IS NULL THEN '1' ELSE '0' END) AS pattern,
  count(*) AS rows FROM ({_EVENTS_WITH_HOLES}) GROUP BY 1""")
def a32(t):
    return A.null_patterns(holes(t), list(_HOLES))


@query("a33_categorical_bars", """
SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM (
  SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2)) WHERE r <= 10""", spread=True)
def a33(t):
    df = t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice")
    return P.categorical_bars(df).drop("rank")


@query("a34_peak", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def a34(t):
    return A.peak(A.yearly_counts(t("orders"), None, "o_orderdate"), "year").withColumn("year", F.col("year").cast("bigint"))


_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'preprocessing' WHEN 'F' THEN 'complete' ELSE 'failed' END"


@query("a35_run_overview", f"""
SELECT count(*) AS total_datasets, CAST(sum(o_custkey) AS BIGINT) AS storage_used_bytes, round(sum(o_custkey) / 1048576.0, 2) AS storage_used_mb,
  count(*) FILTER (s = 'preprocessing') AS processing_count, count(*) FILTER (s = 'complete') AS complete_count FROM (SELECT o_custkey, {_STATUS} AS s FROM orders)""")
def a35(t):
    return A.run_overview(t("orders").select(F.col("o_custkey").alias("file_size_bytes"), F.expr(_STATUS).alias("status")))


@query("a36_facts_pack", f"""
SELECT 'size' AS section, 'rows' AS label, count(*) AS count, NULL AS value FROM orders
UNION ALL SELECT 'size', 'columns', 6, NULL
UNION ALL SELECT 'start', strftime(min(o_orderdate), '%Y-%m-%d'), NULL, NULL FROM orders
UNION ALL SELECT 'end', strftime(max(o_orderdate), '%Y-%m-%d'), NULL, NULL FROM orders
UNION ALL SELECT 'coverage', 'o_orderpriority', NULL, 100.0
UNION ALL SELECT 'coverage', 'o_orderstatus', NULL, 100.0
UNION ALL SELECT 'top_harm', o_orderpriority, count(*), {even('count(*) * 100.0 / (SELECT count(*) FROM orders)', 2)} FROM orders GROUP BY 2
UNION ALL SELECT 'top_sector', o_orderstatus, count(*), {even('count(*) * 100.0 / (SELECT count(*) FROM orders)', 2)} FROM orders GROUP BY 2""")
def a36(t):
    return N.facts_pack(t("orders"), "o_orderdate", {"harm": "o_orderpriority", "sector": "o_orderstatus"})
