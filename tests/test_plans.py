import pytest
from pyspark.sql import functions as F

from tabloom.plans import analyses as N, autoplan as U, incidents as M


@pytest.fixture(scope="module")
def table(spark):
    rows = [("1", 2024, "2024-01-10", "Privacy", "Healthcare", "Org A", "Vendor X", "Incident one"), ("2", 2025, "2025-05-17", "Bias", "Finance", "Org B", "Vendor X", "Incident two"),
            ("3", 2025, "2025-11-02", "Bias", "Finance", "Org B", "Vendor Z", "Incident three")]
    return spark.createDataFrame(rows, "incident_id string, year int, date string, harm_type string, sector_of_deployment string, "
                                       "allegeddeployerofaisystem_primary string, allegeddeveloperofaisystem_primary string, title string")


def test_trend_summary_and_sample(table):
    assert [(r.year, r["count"]) for r in N.trend(table, {}).collect()] == [(2024, 1), (2025, 2)]
    lines = {(r.metric, r.label): r.value for r in N.summary(table, {}).collect()}
    assert lines["rows", None] == "3" and lines["top", "harm_type"] == "Bias" and lines["earliest", "date"] == "2024-01-10T00:00:00"
    assert lines["unique", "deployer"] == "2" and lines["unique", "developer"] == "2"
    assert N.sample_texts(table, {"n": 2}).count() == 2


def test_a_bad_cell_does_not_stop_the_rest(table):
    cells = [{"id": "a", "analysis_type": "trend", "config": {}}, {"id": "b", "analysis_type": "distribution", "config": {"field": "nope"}},
             {"id": "c", "analysis_type": "strange"}, {"id": "d", "analysis_type": "top_n", "config": {"field": "title"}}]
    results, errors = N.run_cells(table, cells)
    assert set(results) == {"a", "d"} and errors == {"b": "the table has no column nope", "c": "Unknown analysis type: strange"}
    status = {(r.cell_id, r.status) for r in N.cells_table(table, cells).collect()}
    assert status == {("a", "success"), ("b", "error"), ("c", "error"), ("d", "success")}


def test_detail_and_highlights(table):
    rows = N.detailed_summary(table, {}).collect()
    change = [r for r in rows if r.section == "change"][0]
    assert change.value == 100.0 and change.label == "2024 to 2025"
    assert [(r.label, r["count"], r.value) for r in rows if r.section == "top_harm"] == [("Bias", 2, 66.7), ("Privacy", 1, 33.3)]
    texts = [r.highlight for r in N.highlights(N.detailed_summary(table, {})).collect()]
    assert texts[0] == "Rows analysed: 3." and any("Bias (2 rows, 66.7%)" in t for t in texts)


def test_custom_field_names(spark):
    df = spark.createDataFrame([("2024-01-01", "2024", "Privacy", "Health", "A", "V"), ("2025-01-01", "2025", "Bias", "Fin", "B", "V")],
                               "event_date string, incident_year string, risk_label string, industry_segment string, responsible_org string, model_vendor string")
    config = {"year_field": "incident_year", "date_field": "event_date", "harm_field": "risk_label", "deployer_field": "responsible_org", "developer_field": "model_vendor"}
    assert N.field_mapping(df, config)["primary_field"] == "risk_label"
    lines = {(r.metric, r.label): r.value for r in N.summary(df, config).collect()}
    assert lines["unique", "deployer"] == "2" and lines["unique", "developer"] == "1"


def test_heatmap_has_zero_cells(table):
    cells = {(r.harm_type, r.sector_of_deployment): r["count"] for r in N.heatmap(table, {"row_field": "harm_type", "col_field": "sector_of_deployment"}).collect()}
    assert cells == {("Privacy", "Healthcare"): 1, ("Privacy", "Finance"): 0, ("Bias", "Healthcare"): 0, ("Bias", "Finance"): 2}


def test_auto_plan_cells_all_run(spark):
    rows = [(2023 + i, f"202{3 + i}-01-01", f"H{i % 2}", f"S{i}", f"Org {i}", f"V{i % 2}", f"headline {i}", "x.org", 0.5 * i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "incident_year int, event_date string, harm_category string, deployment_sector string, org_name string, vendor_name string, "
                                     "incident_headline string, source_domain string, severity_score double, impact_score double")
    plan = U.auto_plan(df)
    assert len(plan) >= 6 and [c["analysis_type"] for c in plan][:2] == ["summary", "trend"]
    assert {r.status for r in N.cells_table(df, plan).collect()} == {"success"}


def test_fixed_plan():
    plan = U.incident_plan()
    assert len(plan) == 15 and plan[0]["id"] == "cell_001" and sum(c["analysis_type"] is None for c in plan) == 2


def tables(spark):
    inc = spark.createDataFrame([(11, "2025-01-01", "[101, 102]", "['Agency A']", "['Vendor A', 'Vendor B']", "T1"), (12, "2025-02-01", "[103, 999]", "['Agency B']", "['Vendor B']", "T2"),
                                 (13, "soon", None, None, None, "T3")],
                                "`incident_id` bigint, date string, reports string, `Alleged deployer of AI system` string, `Alleged developer of AI system` string, title string")
    v1 = spark.createDataFrame([(11, "Safety", "Transportation"), (12, "n/a", "Healthcare")], "`Incident ID` bigint, `Harm Domain` string, `Sector of Deployment` string")
    v0 = spark.createDataFrame([(11, "Physical"), (12, "Privacy")], "`Incident ID` bigint, `Harm Type` string")
    rep = spark.createDataFrame([(101, "example.com", "Report A", "2025-01-05"), (102, "news.org", "Report B", "2025-01-10"), (103, "news.org", "Report C", "2025-01-11")],
                                "report_number bigint, source_domain string, title string, date_published string")
    ent = spark.createDataFrame([("11.0", "Org A"), ("11", "Org B"), ("12", "Org C"), (None, "Nobody")], "incident_id string, name string")
    return inc, v1, v0, rep, ent


def test_incident_assembly(spark):
    inc, v1, v0, rep, ent = tables(spark)
    out = M.normalize(M.assemble(inc, {"classifications_CSETv0": v0, "classifications_CSETv1": v1}, [ent], [rep]))
    rows = {r.incident_id: r for r in out.collect()}
    a, b, c = rows["11"], rows["12"], rows["13"]
    assert (a.harm_type, a.harm_type_all, a.sector_of_deployment) == ("Safety", "Safety, Physical", "Transportation")
    assert a.classification_sources == "classifications_CSETv1, classifications_CSETv0"
    assert (a.entities_involved, a.report_count, a.report_sources, a.latest_report_date) == ("Org A, Org B", 2, "example.com, news.org", "2025-01-10")
    assert (a.year, a.month, a.allegeddeployerofaisystem_primary, a.allegeddeveloperofaisystem_primary) == (2025, 1, "Agency A", "Vendor A")
    assert (b.harm_type, b.report_count, b.report_sources) == ("Privacy", 2, "news.org")
    assert (c.harm_type, c.report_count, c.year) == (None, None, None)


def test_snapshot_folder(spark, tmp_path):
    inc, v1, _, rep, ent = tables(spark)
    for name, df in {"incidents.csv": inc, "classifications_CSETv1.csv": v1, "reports.csv": rep, "entities.csv": ent}.items():
        df.toPandas().to_csv(tmp_path / name, index=False)
    rows = {r.incident_id: r for r in M.load_snapshot(spark, str(tmp_path)).collect()}
    assert rows["11"].report_count == 2 and rows["11"].entities_involved == "Org A, Org B"


def test_priorities():
    assert [M.source_priority(n) for n in ("classifications_CSETv1", "classifications_GMF", "classifications_CSETv1_Annotator-1", "classifications_x")] == [0, 3, 5, 4]


def test_missing_tables_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        M.assemble(spark.createDataFrame([], "incident_id string"))
    (tmp_path / "x.csv").write_text("a\n1\n")
    with pytest.raises(FileNotFoundError):
        M.load_snapshot(spark, str(tmp_path))


def test_filters_reach_the_scan(spark):
    import contextlib
    import io

    from tabloom.operators.rows import apply_filters

    df = apply_filters(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), {"l_quantity": {"min": 10, "max": 20}, "l_returnflag": ["R"]})
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.select("l_orderkey").agg(F.count(F.lit(1))).explain("formatted")
    text = out.getvalue()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "In(l_returnflag" in text or "EqualTo(l_returnflag" in text
    assert "l_extendedprice" not in text


def test_filters_of_another_kind_do_not_fail(spark):
    from tabloom.operators.rows import apply_filters

    df = spark.createDataFrame([("5", 1), ("x", 2), ("true", 3)], "t string, n int")
    found = lambda spec: sorted(r.n for r in apply_filters(df, spec).collect())
    assert [found(s) for s in ({"t": 5}, {"t": [5, "x"]}, {"t": True}, {"n": "2"}, {"n": "abc"}, {"n": [1, "x"]}, {"n": 2})] == [[1], [1, 2], [3], [2], [], [1], [2]]


def test_all_labels_are_paired(spark):
    from tabloom.operators.aggregates import label_pairs

    df = spark.createDataFrame([("['a','b','c','d','e','f']", "['u','v','w','x','y','z']")], "r string, c string")
    assert label_pairs(df, "r", "c").count() == 36 and label_pairs(df, "r", "c", 4).count() == 16


def test_a_report_listed_again_is_met_before_the_lookup(spark):
    incidents = spark.createDataFrame([("1", "[8, 7.0, 8]"), ("1", "['7', 9]"), ("2", "['n/a', '']"), (None, "[7]")], "incident_id string, reports string")
    lookup = spark.createDataFrame([("7", "b", "2024-02-01"), ("8", "a", None)], "report_key string, report_sources string, latest_report_date string")
    rows = M.report_side(incidents, lookup).df
    assert sorted((str(r.incident_id), r._key, r._pos) for r in rows.collect()) == [("1", "7", 0), ("1", "8", 0), ("1", "9", 1), ("None", "7", 0)]
    got = {r.incident_id: (r.report_count, r.report_sources, r.latest_report_date) for r in M.report_summary(incidents, lookup).collect()}
    assert got == {"1": (3, "a, b", "2024-02-01"), None: (1, "b", "2024-02-01")}
