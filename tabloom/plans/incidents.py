"""Assembling one incident table from classification, entity and report tables."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.dates import month_of, parse_date, parse_timestamp, year_of
from ..functions.names import columns_matching, find_table, find_tables_by_prefix, pick_column, rename_incident
from ..functions.text import drop_zero_tail, first_clean, parse_list, value_text
from ..operators.aggregates import Side, join_unique_sides
from ..operators.joins import enrich
from ..operators.rows import coalesce_headers, union_ragged, with_aliases
from ..operators.shape import col, field_types
from ..sources.catalog import list_files
from ..sources.readers import read_delimited, read_json

# --- Fixed values: headers under which each field is published, and the priority of classification files. ---
CLASSIFICATION_FIELDS = {
    "harm_type": ["Risk Domain", "Tangible Harm", "Harm Type", "Special Interest Intangible Harm", "Harm Domain", "Harm.Type"],
    "harm_subtype": ["Risk Subdomain", "Harm Distribution Basis", "Protected Characteristic", "Harmed Class of Entities"],
    "sector_of_deployment": ["Sector of Deployment", "Infrastructure Sectors"],
    "technology_purveyor": ["Technology Purveyor", "Known AI Technology", "Potential AI Technology", "System Developer"],
    "ai_system": ["AI System Description", "AI System", "Known AI Goal", "Potential AI Goal", "AI Task", "Relevant AI functions",
                  "AI Applications"],
    "harm_distribution_basis": ["Harm Distribution Basis", "Protected Characteristic", "Harmed Class of Entities"],
    "intentional_harm": ["Intentional Harm", "Intent"],
    "location_region": ["Location Region", "Location"],
}
LISTED_FIELDS = ["harm_type", "sector_of_deployment", "technology_purveyor", "ai_system"]
INCIDENT_IDS = ["incident_id", "Incident ID", "incident id", "IncidentId", "incidentId"]
REPORT_IDS = ["report_number", "report id", "report_id", "ref_number"]
PRIORITIES = {"classifications_csetv1": 0, "classifications_csetv0": 1, "classifications_mit": 2, "classifications_gmf": 3}
ANNOTATOR_PRIORITY, OTHER_PRIORITY = 5, 4
ENTITY_NAMES = ["name", "entity_name", "entity", "title", "organization"]
REPORT_LISTS = ["reports", "report_ids", "report_numbers"]
REPORT_FIELDS = {"report_sources": ["source_domain", "source", "domain"], "report_titles": ["title"], "report_urls": ["url"]}
REPORT_DATES = ["date_published", "date_submitted", "date_modified", "date_downloaded"]
INCIDENT_DATES = ["date", "incident_date", "Date", "IncidentDate"]
ALIASES = {
    "harm_type": ["Harm.Type", "Harm Type", "Harm Domain", "Risk Domain"],
    "sector_of_deployment": ["Sector of Deployment", "Infrastructure Sectors"],
    "technology_purveyor": ["Technology Purveyor", "Known AI Technology", "Potential AI Technology"],
    "ai_system": ["AI System Description", "AI System", "Known AI Goal", "Potential AI Goal"],
}
LIST_ALIASES = {
    "allegeddeployerofaisystem": ["AllegedDeployerOfAISystem", "Alleged deployer of AI system"],
    "allegeddeveloperofaisystem": ["AllegedDeveloperOfAISystem", "Alleged developer of AI system"],
    "allegedharmedornearlyharmedparties": ["AllegedHarmedOrNearlyHarmedParties", "Alleged harmed or nearly harmed parties"],
}
# --- end of fixed values ---

CLASSIFICATION_COLUMNS = ["classification_sources", *CLASSIFICATION_FIELDS, *[f"{f}_all" for f in LISTED_FIELDS]]
REPORT_COLUMNS = ["report_count", *REPORT_FIELDS, "latest_report_date"]


def ensure_id(df: DataFrame) -> DataFrame | None:
    """The table with a text ``incident_id``, trimmed and without a ``.0`` tail; None when no id column exists."""
    source = "incident_id" if "incident_id" in df.columns else pick_column(df.columns, INCIDENT_IDS)
    if source is None:
        return None
    kind = field_types(df)[source]
    text = value_text(col(source), kind)
    return df.withColumn("incident_id", text if isinstance(kind, T.IntegralType) else drop_zero_tail(text))


def source_priority(source: str) -> int:
    name = source.lower()
    return PRIORITIES.get(name, ANNOTATOR_PRIORITY if "annotator" in name else OTHER_PRIORITY)


def classification_rows(df: DataFrame, source: str) -> DataFrame | None:
    """One classification file brought to the canonical fields, tagged with its source and priority."""
    known = ensure_id(df)
    if known is None:
        return None
    return known.select(
        "incident_id", F.lit(source).alias("classification_source"), F.lit(source_priority(source)).alias("classification_priority"),
        *[coalesce_headers(df, headers).alias(f) for f, headers in CLASSIFICATION_FIELDS.items()])


def published(files: Mapping[str, DataFrame]) -> list[str]:
    """The fields for which some file has a header; the others need no aggregate."""
    return [f for f, headers in CLASSIFICATION_FIELDS.items() if any(columns_matching(df.columns, h) for df in files.values() for h in headers)]


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``incident_id`` and the columns, null texts where there are none."""
    return df.select("incident_id", *[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def classification_side(files: Mapping[str, DataFrame]) -> Side | None:
    # files in order of priority; the place in that order stands for (priority, name) from here on
    ordered = sorted(files, key=lambda name: (source_priority(name), name))
    parts = [p.withColumn("_place", F.lit(i)) for i, name in enumerate(ordered) if (p := classification_rows(files[name], name)) is not None]
    if not parts:
        return None
    rows, fields = union_ragged(*parts).where(F.col("incident_id").isNotNull()), published(files)
    listed = {"classification_sources": "classification_source", **{f"{f}_all": f for f in LISTED_FIELDS if f in fields}}
    return Side(rows, listed, ["_place"], firsts={f: f for f in fields})


def classification_summary(files: Mapping[str, DataFrame]) -> DataFrame | None:
    """Per incident: first value by file priority for each field, and all distinct values of four fields."""
    side = classification_side(files)
    return None if side is None else filled(join_unique_sides([side], ["incident_id"]), CLASSIFICATION_COLUMNS)


def entity_side(files: Sequence[DataFrame], order: Sequence[str] = ()) -> Side | None:
    parts = []
    for df in files:
        known, name = ensure_id(df), pick_column(df.columns, ENTITY_NAMES)
        if known is not None and name:
            parts.append(known.select("incident_id", col(name).cast("string").alias("entity_name"), *[col(o) for o in order if o in df.columns]))
    return Side(union_ragged(*parts), {"entities_involved": "entity_name"}, order) if parts else None


def entity_summary(files: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame | None:
    """Entity names per incident, joined. Rows without an incident id form one group of their own."""
    side = entity_side(files, order)
    return None if side is None else join_unique_sides([side], ["incident_id"])


def report_key(c: Column) -> Column:
    return drop_zero_tail(first_clean(c))


def report_lookup(files: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame | None:
    """Per report key: distinct sources, titles and URLs, and the latest date; only fields that exist."""
    if not files:
        return None
    reports = union_ragged(*files)
    id_col = pick_column(reports.columns, REPORT_IDS)
    if id_col is None:
        return None
    types = field_types(reports)
    keyed = reports.withColumn("report_key", report_key(value_text(col(id_col), types[id_col]))).where(F.col("report_key").isNotNull())
    texts = {n: c for n, headers in REPORT_FIELDS.items() if (c := pick_column(reports.columns, headers))}
    date = pick_column(reports.columns, REPORT_DATES)
    if not texts and not date:
        return None
    latest = {"latest_report_date": parse_date(col(date), types[date])} if date else {}
    out = join_unique_sides([Side(keyed, texts, order, latest=latest)], ["report_key"])
    return out.withColumns({c: iso_date(c) for c in latest})


def iso_date(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


def report_side(incidents: DataFrame, lookup: DataFrame | None) -> Side | None:
    """One row per report key that an incident row lists, with what is known of that report."""
    listed = pick_column(incidents.columns, REPORT_LISTS)
    if listed is None:
        return None
    items = parse_list(value_text(col(listed), field_types(incidents)[listed]))
    if lookup is None:
        lookup = incidents.sparkSession.createDataFrame([], "report_key string")
    if "latest_report_date" not in lookup.columns:
        lookup = lookup.withColumn("latest_report_date", F.lit(None).cast("string"))
    lookup = lookup.withColumn("latest_report_date", parse_date(F.col("latest_report_date")))  # once a report, not once a listing
    listed_keys = incidents.select("incident_id", F.posexplode(items).alias("_pos", "_item")).select("incident_id", "_pos", report_key(F.col("_item")).alias("_key"))
    # a report that an incident lists again is met before the lookup, whose texts then travel once and only as far as they are read
    listed_keys = listed_keys.where(F.col("_key").isNotNull()).groupBy("incident_id", "_key").agg(F.min("_pos").alias("_pos"))
    rows = listed_keys.join(lookup.withColumnRenamed("report_key", "_lookup"), F.col("_key") == F.col("_lookup"), "left")
    return Side(rows, {n: n for n in REPORT_FIELDS if n in lookup.columns}, ["_pos"], counts={"report_count": "_key"},
                latest={"latest_report_date": F.col("latest_report_date")}, distinct=True)


def report_summary(incidents: DataFrame, lookup: DataFrame | None) -> DataFrame | None:
    """Per incident: number of distinct reports it lists, and what is known of them. Incidents listing none have no row."""
    side = report_side(incidents, lookup)
    if side is None:
        return None
    return filled(join_unique_sides([side], ["incident_id"]), REPORT_COLUMNS).withColumn("latest_report_date", iso_date("latest_report_date"))


def assemble(
    incidents: DataFrame, classifications: Mapping[str, DataFrame] | None = None, entities: Sequence[DataFrame] = (),
    reports: Sequence[DataFrame] = (), entity_order: Sequence[str] = (), report_order: Sequence[str] = (),
) -> DataFrame:
    """The incident table with classification, entity and report columns joined on.

    Rows of a table have no order, so names are listed alphabetically unless order columns are given.
    """
    if incidents.isEmpty():
        raise FileNotFoundError("No incident records found.")
    base = ensure_id(incidents)
    if base is None:
        raise ValueError("the incident table has no id column")
    columns = {"classification": CLASSIFICATION_COLUMNS, "entity": ["entities_involved"], "report": REPORT_COLUMNS}
    sides = {"classification": classification_side(classifications or {}), "entity": entity_side(entities, entity_order),
             "report": report_side(base, report_lookup(reports, report_order))}
    present = {n: side for n, side in sides.items() if side is not None}
    if not present:
        return base
    # all sides meet in one aggregate by id, joined once; the join's own shuffle lets a hot id of incidents be split
    found = join_unique_sides(list(present.values()), ["incident_id"])
    found = filled(found, [c for n in present for c in columns[n]])
    return enrich(base, "incident_id", found.withColumn("latest_report_date", iso_date("latest_report_date")) if "report" in present else found)


def normalize(df: DataFrame) -> DataFrame:
    """Date parts, canonical field copies, first items of list fields, and plain column names."""
    date = pick_column(df.columns, INCIDENT_DATES)
    if date:
        dtype = field_types(df)[date]
        moment = parse_timestamp(col(date), dtype)
        df = df.withColumns({"year": year_of(col(date), dtype), "month": month_of(col(date), dtype), date: moment})
    return rename_incident(with_aliases(with_aliases(df, ALIASES), LIST_ALIASES, primary=True))


def load_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Read an extracted snapshot directory and give the assembled, normalised incident table."""
    paths = sorted(r.path for r in list_files(spark, root).select("path").collect())

    def read(path: str) -> DataFrame:
        # text columns hold quoted line breaks in these exports
        return read_delimited(spark, path, multi_line=True)[0] if path.lower().endswith(".csv") else read_json(spark, path)

    main = find_table(paths, "/incidents.csv") or find_table(paths, "/incidents.json") or next(iter(find_tables_by_prefix(paths, "incidents")), None)
    if main is None:
        raise FileNotFoundError("no incidents table in the snapshot")
    named = lambda prefix: {posixpath.splitext(posixpath.basename(p))[0]: read(p) for p in find_tables_by_prefix(paths, prefix)}
    return normalize(assemble(read(main), named("classifications"), list(named("entities").values()), list(named("reports").values())))
