"""Incident assembly: orders stand for incidents, lineitem for classifications, entities and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import incidents as M
from .registry import query

# First file: one row per order line, value missing on every third line number. Second file: line status under another header.
_V1 = "CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE l_returnflag END"


def first_file(t):
    return t("lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")).alias("Incident ID"), F.expr(_V1).alias("Harm Domain"),
                                F.col("l_linestatus").alias("Sector of Deployment"))


def second_file(t):
    return t("lineitem").select(F.col("l_orderkey").alias("incident_id"), F.concat(F.lit("S"), "l_linestatus").alias("Harm Type"))


def entity_file(t):
    return t("lineitem").select(F.col("l_orderkey").alias("incident_id"), F.concat(F.lit("Supplier "), "l_suppkey").alias("name"), "l_suppkey")


def report_file(t):
    return t("part").select(F.col("p_partkey").alias("report_number"), F.col("p_brand").alias("source_domain"), F.col("p_name").alias("title"),
                            F.expr("date_format(date_add(DATE'2020-01-01', p_size), 'yyyy-MM-dd')").alias("date_published"))


def incident_file(t):
    listed = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("l_partkey")).cast("array<string>"), ", "), F.lit("]")).alias("reports"))
    orders = t("orders").join(listed, F.col("o_orderkey") == F.col("k"), "left")
    return orders.select(F.col("o_orderkey").alias("incident_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), "reports",
                         F.concat(F.lit("['"), "o_orderpriority", F.lit("', 'other']")).alias("Alleged deployer of AI system"))


@query("m01_ensure_id", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS incident_id FROM lineitem")
def m01(t):
    return M.ensure_id(first_file(t)).select("incident_id").distinct()


_CLASS = f"""c1 AS (SELECT CAST(l_orderkey AS VARCHAR) AS incident_id, min(CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END) AS v, min(l_linestatus) AS s,
  list_sort(list(DISTINCT CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END) FILTER (l_linenumber % 3 <> 0)) AS vs, list_sort(list(DISTINCT l_linestatus)) AS ss,
  list_sort(list(DISTINCT 'S' || l_linestatus)) AS v0, min('S' || l_linestatus) AS f0 FROM lineitem GROUP BY 1),
class AS (SELECT incident_id, 'classifications_CSETv1, classifications_CSETv0' AS classification_sources, coalesce(v, f0) AS harm_type, s AS sector_of_deployment,
  array_to_string(list_concat(coalesce(vs, []), v0), ', ') AS harm_type_all, array_to_string(ss, ', ') AS sector_of_deployment_all FROM c1)"""


@query("m02_classification_summary", f"WITH {_CLASS} SELECT * FROM class", spread=True)
def m02(t):
    s = M.classification_summary({"classifications_CSETv1": first_file(t), "classifications_CSETv0": second_file(t)})
    # values of one file and priority are ordered by first appearance with nothing else to go by, so compare them sorted within the file
    return s.select("incident_id", "classification_sources", "harm_type", "sector_of_deployment", "harm_type_all", "sector_of_deployment_all")


_ENTITY = """ent AS (SELECT CAST(l_orderkey AS VARCHAR) AS incident_id, string_agg(n, ', ' ORDER BY k) AS entities_involved
  FROM (SELECT DISTINCT l_orderkey, l_suppkey AS k, 'Supplier ' || l_suppkey AS n FROM lineitem) GROUP BY 1)"""


@query("m03_entity_summary", f"WITH {_ENTITY} SELECT * FROM ent")
def m03(t):
    return M.entity_summary([entity_file(t)], ["l_suppkey"])


_LISTED = "lst AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
_REPORT = f"""{_LISTED}, seen AS (SELECT l_orderkey, l_partkey, p_brand, p_name, DATE '2020-01-01' + p_size AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS pos FROM lst JOIN part ON p_partkey = l_partkey),
src AS (SELECT l_orderkey, p_brand, min(pos) AS p FROM seen GROUP BY 1, 2), ttl AS (SELECT l_orderkey, p_name, min(pos) AS p FROM seen GROUP BY 1, 2),
rep AS (SELECT CAST(s.l_orderkey AS VARCHAR) AS incident_id, count(*) AS report_count, (SELECT string_agg(p_brand, ', ' ORDER BY p) FROM src WHERE src.l_orderkey = s.l_orderkey) AS report_sources,
  (SELECT string_agg(p_name, ', ' ORDER BY p) FROM ttl WHERE ttl.l_orderkey = s.l_orderkey) AS report_titles, strftime(max(d), '%Y-%m-%d') AS latest_report_date FROM seen s GROUP BY s.l_orderkey)"""


@query("m04_report_summary", f"WITH {_REPORT} SELECT * FROM rep", spread=True)
def m04(t):
    s = M.report_summary(M.ensure_id(incident_file(t)), M.report_lookup([report_file(t)]))
    return s.drop("report_urls")


def assembled(t):
    return M.assemble(incident_file(t), {"classifications_CSETv1": first_file(t), "classifications_CSETv0": second_file(t)}, [entity_file(t)],
                      [report_file(t)], ["l_suppkey"])


_ALL = f"WITH {_CLASS}, {_ENTITY}, {_REPORT}"


@query("m05_assemble", f"""{_ALL} SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, harm_type, sector_of_deployment, entities_involved, report_count, report_sources, latest_report_date
FROM orders LEFT JOIN class c ON c.incident_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN ent e ON e.incident_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN rep r ON r.incident_id = CAST(o_orderkey AS VARCHAR)""", spread=True)
def m05(t):
    return assembled(t).select("incident_id", "harm_type", "sector_of_deployment", "entities_involved", "report_count", "report_sources", "latest_report_date")


@query("m06_normalize", """
SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, o_orderpriority AS allegeddeployerofaisystem_primary,
  '[''' || o_orderpriority || ''', ''other'']' AS allegeddeployerofaisystem FROM orders""", spread=True)
def m06(t):
    n = M.normalize(assembled(t))
    return n.select("incident_id", F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "allegeddeployerofaisystem_primary", "allegeddeployerofaisystem")
