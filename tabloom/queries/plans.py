"""Declarative analyses and automatic plans over orders read as an incident-like table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.windows import first_last_change  # noqa: F401
from ..plans import analyses as N, autoplan as U
from .registry import query
from .sqltext import even, union

_BASE = ("SELECT o_orderkey AS incident_id, o_orderdate AS date, year(o_orderdate) AS year, month(o_orderdate) AS month, "
         "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS harm_type, o_orderstatus AS sector_of_deployment, "
         "'Customer ' || o_custkey AS deployer, o_totalprice AS amount FROM orders")
_T = f"WITH t AS ({_BASE}) "


def incidents_like(t):
    return t("orders").select(
        F.col("o_orderkey").alias("incident_id"), F.col("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END").alias("harm_type"), F.col("o_orderstatus").alias("sector_of_deployment"),
        F.concat(F.lit("Customer "), "o_custkey").alias("deployer"), F.col("o_totalprice").alias("amount"))


def cell(kind, **config):
    return {"id": "x", "analysis_type": kind, "config": config}


@query("n01_trend", _T + "SELECT CAST(year AS BIGINT) AS year, harm_type, count(*) AS count FROM t GROUP BY 1, 2")
def n01(t):
    out = N.run_cell(incidents_like(t), cell("trend", x_field="year", group_by="harm_type"))
    return out.withColumn("year", F.col("year").cast("bigint"))


@query("n01b_trend_change", _T + """, y AS (SELECT year, count(*) AS n FROM t GROUP BY 1)
SELECT CAST(min(year) AS BIGINT) AS first_x, CAST(max(year) AS BIGINT) AS last_x, round((max_by(n, year) - min_by(n, year)) * 100.0 / min_by(n, year), 6) AS change_pct,
  (SELECT CAST(year AS BIGINT) FROM y ORDER BY n DESC, year LIMIT 1) AS peak_x, max(n) AS peak_value FROM y""")
def n01b(t):
    c = N.trend_change(incidents_like(t), {"x_field": "year"})
    return c.select(*[F.col(x).cast("bigint").alias(x) for x in ("first_x", "last_x", "peak_x")], F.round("change_pct", 6).alias("change_pct"), "peak_value")


@query("n02_distribution", _T + f""", c AS (SELECT harm_type, count(*) AS count FROM t GROUP BY 1)
SELECT harm_type, count, {even("count * 100.0 / (SELECT sum(count) FROM c WHERE harm_type IS NOT NULL)", 1)} AS percentage FROM c ORDER BY count DESC, harm_type NULLS LAST LIMIT 15""")
def n02(t):
    return N.run_cell(incidents_like(t), cell("distribution", field="harm_type"))


@query("n02b_distribution_totals", _T + "SELECT count(harm_type) AS total_records, count(*) FILTER (harm_type IS NULL) AS null_count FROM t")
def n02b(t):
    return N.distribution_totals(incidents_like(t), {"field": "harm_type"})


@query("n03_comparison", _T + "SELECT harm_type, round(avg(amount), 4) AS amount FROM t GROUP BY 1")
def n03(t):
    out = N.run_cell(incidents_like(t), cell("comparison", x_field="harm_type", y_field="amount", agg="mean"))
    return out.withColumn("amount", F.round("amount", 4))


@query("n03b_comparison_filtered", _T + "SELECT deployer, count(*) AS count FROM t WHERE year BETWEEN 1996 AND 1999 AND sector_of_deployment IN ('P', 'F') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def n03b(t):
    return N.run_cell(incidents_like(t), cell("comparison", x_field="deployer", filters={"year": {"min": 1996, "max": 1999}, "sector_of_deployment": ["P", "F"]}))


@query("n04_summary", _T + """
SELECT 'rows' AS metric, NULL AS label, CAST(count(*) AS VARCHAR) AS value FROM t UNION ALL SELECT 'columns', NULL, '8'
UNION ALL SELECT 'earliest', 'date', strftime(min(date), '%Y-%m-%dT%H:%M:%S') FROM t UNION ALL SELECT 'latest', 'date', strftime(max(date), '%Y-%m-%dT%H:%M:%S') FROM t
UNION ALL SELECT 'unique', 'deployer', CAST(count(DISTINCT deployer) AS VARCHAR) FROM t UNION ALL SELECT 'unique', 'kinds', CAST(count(DISTINCT harm_type) AS VARCHAR) FROM t
UNION ALL (SELECT 'top', 'harm_type', harm_type FROM t WHERE harm_type IS NOT NULL GROUP BY harm_type ORDER BY count(*) DESC, harm_type LIMIT 1)
UNION ALL (SELECT 'top', 'sector_of_deployment', sector_of_deployment FROM t GROUP BY sector_of_deployment ORDER BY count(*) DESC, sector_of_deployment LIMIT 1)""")
def n04(t):
    return N.run_cell(incidents_like(t), cell("summary", deployer_field="deployer", unique_fields={"kinds": "harm_type"}))


@query("n05_correlation_matrix", _T + union([f"SELECT '{a}' AS col1, '{b}' AS col2, " + ("1.0" if a == b else f"round((SELECT corr({a}, {b}) FROM t), 9)") + " AS r"
                                             for a in ("incident_id", "year", "month", "amount") for b in ("incident_id", "year", "month", "amount")]))
def n05(t):
    return N.run_cell(incidents_like(t), cell("correlation")).withColumn("r", F.round("r", 9))


@query("n05b_correlation_pair", _T + "SELECT round(corr(amount, month), 9) AS value, count(*) AS sample_size FROM t")
def n05b(t):
    return N.run_cell(incidents_like(t), cell("correlation", x_field="amount", y_field="month")).select(F.round("value", 9).alias("value"), "sample_size")


@query("n06_top_n", _T + "SELECT deployer AS entity, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def n06(t):
    return N.run_cell(incidents_like(t), cell("top_n", field="deployer"))


@query("n07_heatmap", _T + """, a AS (SELECT deployer FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8), b AS (SELECT harm_type FROM t WHERE harm_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)
SELECT deployer, harm_type, count(t.deployer) AS count FROM a CROSS JOIN b LEFT JOIN t USING (deployer, harm_type) GROUP BY 1, 2""")
def n07(t):
    return N.run_cell(incidents_like(t), cell("heatmap", row_field="deployer", col_field="harm_type"))


@query("n08_text_sample")
def n08(t):
    return N.run_cell(t("documents"), cell("text_sample", field="text", n=10))


@query("n08b_text_sample_properties", "SELECT least(10, count(*)) AS rows, least(10, count(*)) AS from_table FROM documents WHERE text IS NOT NULL")
def n08b(t):
    sample = N.run_cell(t("documents"), cell("text_sample", field="text", n=10))
    member = sample.join(t("documents").select(F.col("text").alias("sample")).distinct(), "sample", "left_semi").agg(F.count(F.lit(1)))
    return sample.agg(F.count(F.lit(1)).alias("rows")).select("rows", member.scalar().alias("from_table"))


@query("n09_detailed_summary", _T + f""", y AS (SELECT year, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT harm_type AS v, count(*) AS n FROM t WHERE harm_type IS NOT NULL GROUP BY 1), s AS (SELECT sector_of_deployment AS v, count(*) AS n FROM t GROUP BY 1), d AS (SELECT deployer AS v, count(*) AS n FROM t GROUP BY 1)
SELECT 'total' AS section, CAST(1 AS BIGINT) AS position, NULL AS label, count(*) AS count, NULL AS value FROM t
UNION ALL SELECT 'yearly', row_number() OVER (ORDER BY year), CAST(year AS VARCHAR), n, NULL FROM y
UNION ALL SELECT 'change', 1, min(year) || ' to ' || max(year), NULL, round((max_by(n, year) - min_by(n, year)) * 100.0 / min_by(n, year), 6) FROM y
UNION ALL (SELECT 'peak', 1, CAST(year AS VARCHAR), n, NULL FROM y ORDER BY n DESC, year LIMIT 1)
UNION ALL (SELECT 'top_harm', row_number() OVER (ORDER BY n DESC, v), v, n, {even('n * 100.0 / (SELECT sum(n) FROM h)', 1)} FROM h ORDER BY n DESC, v LIMIT 5)
UNION ALL (SELECT 'top_sector', row_number() OVER (ORDER BY n DESC, v), v, n, {even('n * 100.0 / (SELECT sum(n) FROM s)', 1)} FROM s ORDER BY n DESC, v LIMIT 5)
UNION ALL (SELECT 'top_deployer', row_number() OVER (ORDER BY n DESC, v), v, n, {even('n * 100.0 / (SELECT sum(n) FROM d)', 1)} FROM d ORDER BY n DESC, v LIMIT 5)
UNION ALL SELECT 'coverage', 1, 'date', NULL, 100.0 UNION ALL SELECT 'coverage', 2, 'deployer', NULL, 100.0
UNION ALL SELECT 'coverage', 3, 'harm_type', NULL, round(count(harm_type) * 100.0 / count(*), 1) FROM t UNION ALL SELECT 'coverage', 4, 'sector_of_deployment', NULL, 100.0""")
def n09(t):
    out = N.run_cell(incidents_like(t), cell("detailed_summary", deployer_field="deployer"))
    return out.withColumns({"value": F.round("value", 6), "position": F.col("position").cast("bigint")})


@query("n09b_highlights", _T + """
SELECT CAST(0 AS BIGINT) AS position, 'Rows analysed: ' || count(*) || '.' AS highlight FROM t
UNION ALL (SELECT 2, 'Peak period: ' || year || ' with ' || count(*) || ' rows.' FROM t GROUP BY year ORDER BY count(*) DESC, year LIMIT 1)""")
def n09b(t):
    lines = N.highlights(N.run_cell(incidents_like(t), cell("detailed_summary")))
    return lines.where("position in (0, 2)").withColumn("position", F.col("position").cast("bigint"))


@query("n10_run_cells", _T + """
SELECT 'a' AS cell_id, 'success' AS status, count(DISTINCT year) AS records FROM t UNION ALL SELECT 'b', 'error', 1 UNION ALL SELECT 'c', 'success', 3
UNION ALL SELECT 'd', 'error', 1""")
def n10(t):
    cells = [{**cell("trend"), "id": "a"}, {**cell("distribution", field="missing"), "id": "b"}, {**cell("top_n", field="sector_of_deployment"), "id": "c"},
             {**cell("no_such_analysis"), "id": "d"}, {"id": "e", "type": "text"}]
    return N.cells_table(incidents_like(t), cells).groupBy("cell_id", "status").agg(F.count(F.lit(1)).alias("records"))


@query("n10b_run_cells_dirty", _T + """
SELECT 'good' AS cell_id, 'success' AS status, count(DISTINCT sector_of_deployment) AS records FROM t UNION ALL SELECT 'pattern', 'error', 1""")
def n10b(t):
    """A bad pattern fails alone, a filter of another kind than its column finds nothing."""
    filters = lambda f: {**cell("top_n", field="sector_of_deployment", filters=f)}
    cells = [{**cell("top_n", field="sector_of_deployment"), "id": "good"}, {**filters({"sector_of_deployment": {"contains": "("}}), "id": "pattern"},
             {**filters({"incident_id": "no number"}), "id": "typed"}]
    return N.cells_table(incidents_like(t), cells).groupBy("cell_id", "status").agg(F.count(F.lit(1)).alias("records"))


@query("n11_auto_plan", _T + """
SELECT 'categorical' AS use, 'harm_type' AS "column", round(count(harm_type) / count(*) + 0.2 - count(DISTINCT harm_type) / 200.0, 6) AS score FROM t
UNION ALL SELECT 'categorical', 'sector_of_deployment', round(1.2 - count(DISTINCT sector_of_deployment) / 200.0, 6) FROM t
UNION ALL SELECT 'classification_target', 'harm_type', 0.0 UNION ALL SELECT 'classification_target', 'sector_of_deployment', 0.0
UNION ALL SELECT 'numeric', 'incident_id', round(1 + least(count(DISTINCT incident_id), 500) / 1000.0, 6) FROM t
UNION ALL SELECT 'numeric', 'month', round(1 + least(count(DISTINCT month), 500) / 1000.0, 6) FROM t
UNION ALL SELECT 'numeric', 'year', round(1 + least(count(DISTINCT year), 500) / 1000.0, 6) FROM t
UNION ALL SELECT 'numeric', 'amount', round(1 + least(count(DISTINCT amount), 500) / 1000.0, 6) FROM t
UNION ALL SELECT 'regression_target', 'incident_id', 0.0 UNION ALL SELECT 'regression_target', 'month', 0.0 UNION ALL SELECT 'regression_target', 'amount', 0.0""")
def n11(t):
    ranked = U.ranked_fields(U.column_facts(incidents_like(t)), ["year", "date"])
    # with more than 80 distinct deployers that column is no category
    return ranked.select("use", "column", F.round("score", 6).alias("score"))


@query("n11b_auto_plan_cells", spread=True)
def n11b(t):
    df = incidents_like(t)
    return N.cells_table(df, U.auto_plan(df)).groupBy("cell_id", "status").agg(F.count(F.lit(1)).alias("records"))


@query("n12_incident_plan", spread=True)
def n12(t):
    df = incidents_like(t).withColumn("allegeddeployerofaisystem_primary", F.col("deployer")).withColumn("report_sources", F.col("sector_of_deployment"))
    df = df.withColumn("allegeddeveloperofaisystem_primary", F.col("deployer")).withColumn("title", F.col("deployer"))
    return N.cells_table(df, U.incident_plan()).groupBy("cell_id", "status").agg(F.count(F.lit(1)).alias("records"))


@query("n13_yearly_momentum", _T + """, y AS (SELECT year, count(*) AS n FROM t GROUP BY 1)
SELECT CAST(year AS BIGINT) AS year, n AS incidents, round(avg(n) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_3y, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM y""")
def n13(t):
    return N.yearly_momentum(incidents_like(t), "year").withColumns({"year": F.col("year").cast("bigint"), "rolling_3y": F.round("rolling_3y", 6)})


@query("n14_monthly_rhythm", """
SELECT strftime(m, '%Y-%m-%d') AS month_start, n AS incidents, round(avg(n) OVER (ORDER BY m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS rolling_6m
FROM (SELECT date_trunc('month', ts) AS m, count(*) AS n FROM events GROUP BY 1)""")
def n14(t):
    return N.monthly_rhythm(t("events"), "ts").select(F.col("month_start").cast("string").alias("month_start"), "incidents", F.round("rolling_6m", 6).alias("rolling_6m"))


@query("n15_label_matrix", """
WITH x AS (SELECT unnest([p_type, p_brand]) AS a, p_size AS s FROM part), y AS (SELECT a, 'size ' || s AS b FROM x), ta AS (SELECT a FROM y GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
tb AS (SELECT b FROM y GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT a, b, count(y.a) AS count FROM ta CROSS JOIN tb LEFT JOIN y USING (a, b) GROUP BY 1, 2
HAVING a IN (SELECT a FROM y WHERE b IN (FROM tb)) AND b IN (SELECT b FROM y WHERE a IN (FROM ta))""")
def n15(t):
    df = t("part").select(F.concat_ws("; ", "p_type", "p_brand").alias("a"), F.concat(F.lit("size "), "p_size").alias("b"))
    return N.label_matrix(df, "a", "b")


@query("n15b_entity_links", _T + """, u AS (SELECT deployer, harm_type FROM t WHERE harm_type IS NOT NULL), a AS (SELECT deployer FROM u GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12),
b AS (SELECT harm_type FROM u GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT deployer, harm_type, count(*) AS value FROM u WHERE deployer IN (FROM a) AND harm_type IN (FROM b) GROUP BY 1, 2""")
def n15b(t):
    return N.entity_links(incidents_like(t), "deployer", "harm_type")


@query("n15c_source_footprint", """
WITH c AS (SELECT source AS label, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) SELECT label, count FROM c""")
def n15c(t):
    from ..operators.aggregates import label_counts

    return label_counts(t("documents"), "source", 15).select("label", "count")
