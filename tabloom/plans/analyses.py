"""Declarative analyses: a small spec in, a DataFrame out.

Every analysis is lazy. Missing columns and bad specs raise when the analysis is built, so one bad cell of a notebook can
be reported without running, or stopping, the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.names import pick_column
from ..functions.dates import month_start, parse_timestamp
from ..operators import aggregates as A
from ..operators.joins import top_categories_only
from ..operators.rows import apply_filters, text_sample
from ..operators.shape import col, field_types
from ..operators.windows import first_last_change, rolling_mean, running_sum
from ..session import cut_lineage

# Default field names of the incident analyses.
DATE_FIELDS = ["date", "incident_date", "event_date", "created_at"]
DEFAULTS = {
    "harm_field": "harm_type", "sector_field": "sector_of_deployment",
    "deployer_field": "allegeddeployerofaisystem_primary", "developer_field": "allegeddeveloperofaisystem_primary",
}


def _need(df: DataFrame, config: Mapping, key: str) -> str:
    name = config.get(key)
    if not name:
        raise ValueError(f"the cell's config has no {key}")
    if name not in df.columns:
        raise ValueError(f"the table has no column {name}")
    return name


def _field(df: DataFrame, config: Mapping, key: str) -> str | None:
    return pick_column(df.columns, [config.get(key), DEFAULTS[key]], ignore_case=False)


def trend(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Row counts along ``x_field``, optionally per ``group_by``, ordered by x with nulls last."""
    x = config.get("x_field", "year")
    if x not in df.columns:
        raise ValueError(f"Column '{x}' not found")
    group = config.get("group_by")
    keys = [x, group] if group and group in df.columns else [x]
    return A.group_count(df, *keys).orderBy(*[col(k).asc_nulls_last() for k in keys])


def trend_change(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """One row: first, last, percent change, direction and peak of a trend."""
    x = config.get("x_field", "year")
    line = A.group_count(df, x).where(col(x).isNotNull())
    top = A.peak(line, x)
    return first_last_change(line, x, "count").withColumns({
        "peak_x": top.select(col(x)).scalar(), "peak_value": top.select("count").scalar()})


def distribution(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    return A.value_counts(df, _need(df, config, "field"), int(config.get("top_n", 15)))


def distribution_totals(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    f = col(_need(df, config, "field"))
    return df.agg(F.count(f).alias("total_records"), F.count_if(f.isNull()).alias("null_count"))


def comparison(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    x, y = _need(df, config, "x_field"), config.get("y_field")
    if y and y != "count" and y not in df.columns:
        raise ValueError(f"Column '{y}' not found")
    return A.grouped_metric(df, x, y, str(config.get("agg", "count")).lower(), int(config.get("top_n", 20)))


def _top_value(df: DataFrame, field: str):
    return A.ranked(A.group_count(df.where(col(field).isNotNull()), field), field, 1).select(col(field).cast("string"))


def summary(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """``(metric, label, value)`` rows: sizes, date range, distinct counts and top values."""
    have = set(df.columns)
    date = pick_column(df.columns, [config.get("date_field"), *DATE_FIELDS], ignore_case=False)
    fields = {k: _field(df, config, k) for k in DEFAULTS}
    tops = [f for f in map(str, config.get("top_fields") or []) if f in have] or [
        f for f in (fields["harm_field"], fields["sector_field"]) if f]
    wanted = config.get("unique_fields") or {}
    unique = dict(wanted) if isinstance(wanted, Mapping) else {f: f for f in wanted}
    unique = {str(k): f for k, f in unique.items() if f in have}
    for label, key in (("deployer", "deployer_field"), ("developer", "developer_field")):
        if fields[key]:
            unique.setdefault(label, fields[key])

    def line(metric: str, label: str | None, value):
        return F.struct(F.lit(metric).alias("metric"), F.lit(label).cast("string").alias("label"), value.cast("string").alias("value"))

    sizes = [line("rows", None, F.col("_rows")), line("columns", None, F.lit(len(df.columns)))]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    if date:
        moment = parse_timestamp(col(date), field_types(df)[date])
        aggs += [F.min(moment).alias("_first"), F.max(moment).alias("_last")]
        form = "yyyy-MM-dd'T'HH:mm:ss"
        sizes += [line("earliest", date, F.date_format("_first", form)), line("latest", date, F.date_format("_last", form))]
    parts = [df.agg(*aggs).select(F.inline(F.array(*sizes)))]
    if unique:
        counts = A.distinct_counts(df, list(dict.fromkeys(unique.values())))
        names = df.sparkSession.createDataFrame(list(unique.items()), "label string, column string")
        parts.append(names.join(counts, "column").select(F.lit("unique").alias("metric"), "label", F.col("n_distinct").cast("string").alias("value")))
    for f in dict.fromkeys([*tops, *[fields[k] for k in ("harm_field", "sector_field") if fields[k]]]):
        parts.append(_top_value(df, f).select(F.lit("top").alias("metric"), F.lit(f).alias("label"), col(f).alias("value")))
    return reduce(DataFrame.unionAll, parts)


def correlation(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """One pair when both fields are given, else the whole matrix in long form."""
    x, y = config.get("x_field"), config.get("y_field")
    if x and y:
        if x not in df.columns or y not in df.columns:
            raise ValueError("x_field or y_field not found")
        return A.correlation_pair(df, x, y)
    return A.correlation_matrix(df)


def top_n(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    field = _need(df, config, "field")
    counts = df.groupBy(col(field).alias("entity")).agg(F.count(F.lit(1)).alias("count"))
    return A.ranked(counts, "entity", int(config.get("n", 10)))


def heatmap(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Long contingency table of the top ``top_n`` values of two fields, zero cells included."""
    row, column = _need(df, config, "row_field"), _need(df, config, "col_field")
    kept = top_categories_only(df, [row, column], int(config.get("top_n", 8)))
    cells = A.crosstab(kept, row, column)
    return with_zero_cells(cells, row, column)


def with_zero_cells(cells: DataFrame, row: str, column: str) -> DataFrame:
    """Add the absent combinations of the row and column values at hand, with count 0.

    The input is an aggregated table of at most top_n rows by top_n columns; the column values travel as one array.
    """
    columns = cells.agg(F.array_sort(F.collect_set(col(column)))).scalar()
    grid = cells.select(col(row)).distinct().select(col(row).alias("_r"), F.explode(columns).alias("_c"))
    on = (F.col("_r") == col(row)) & (F.col("_c") == col(column))
    return grid.join(cells, on, "left").select(
        F.col("_r").alias(row), F.col("_c").alias(column), F.coalesce("count", F.lit(0)).alias("count"))


def sample_texts(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    field = config.get("field", "title")
    if field not in df.columns:
        raise ValueError(f"Column '{field}' not found")
    return text_sample(df, field, int(config.get("n", 10)))


def detailed_summary(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """``(section, position, label, count, value)`` rows: yearly counts, four top lists, coverage and change."""
    n = int(config.get("top_n", 5))
    year = pick_column(df.columns, [config.get("year_field"), "year"], ignore_case=False)
    date = pick_column(df.columns, [config.get("date_field"), *DATE_FIELDS[:3]], ignore_case=False)
    fields = {k: _field(df, config, k) for k in DEFAULTS}
    shape = lambda d, section, order, label, count, value: d.select(
        F.lit(section).alias("section"), F.row_number().over(order).alias("position"), label.cast("string").alias("label"),
        count.cast("bigint").alias("count"), value.cast("double").alias("value"))
    nothing = F.lit(None)
    parts = []
    total = df.agg(F.count(F.lit(1)).alias("count"))
    parts.append(total.select(F.lit("total").alias("section"), F.lit(1).alias("position"), nothing.cast("string").alias("label"),
                              F.col("count"), nothing.cast("double").alias("value")))
    if year or date:
        yearly = A.yearly_counts(df, year) if year else A.yearly_counts(df, None, date)
        # an aggregated series with one row per year
        parts.append(shape(yearly, "yearly", Window.orderBy("year"), F.col("year"), F.col("count"), nothing))
        change = first_last_change(yearly, "year", "count", when_zero=None)
        parts.append(change.where("points >= 2").select(
            F.lit("change").alias("section"), F.lit(1).alias("position"),
            F.concat_ws(" to ", F.col("first_x").cast("string"), F.col("last_x").cast("string")).alias("label"),
            nothing.cast("bigint").alias("count"), F.col("change_pct").alias("value")))
        peak = A.peak(yearly, "year")
        parts.append(peak.select(F.lit("peak").alias("section"), F.lit(1).alias("position"), F.col("year").cast("string").alias("label"),
                                 F.col("count"), nothing.cast("double").alias("value")))
    for key, f in fields.items():
        if f:
            top = A.top_values(df, f, n)
            order = Window.orderBy(F.col("count").desc(), F.col("value"))  # at most top_n rows
            parts.append(shape(top, f"top_{key.removesuffix('_field')}", order, F.col("value"), F.col("count"), F.col("percentage")))
    covered = [f for f in [*fields.values(), date] if f]
    if covered:
        cov = A.coverage(df, list(dict.fromkeys(covered)))
        parts.append(shape(cov, "coverage", Window.orderBy("field"), F.col("field"), nothing, F.col("coverage_pct")))
    return reduce(DataFrame.unionAll, parts)


def highlights(detail: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Sentences drawn from a detailed summary, in reading order."""
    names = {"top_harm": "top categories", "top_sector": "secondary categories", "top_deployer": "top entities",
             "top_developer": "secondary entities", **(labels or {})}
    text = F.when(F.col("section") == "total", F.format_string("Rows analysed: %d.", "count"))
    text = text.when(F.col("section") == "change", F.format_string("Volume changed by %.1f%% from %s.", "value", "label"))
    text = text.when(F.col("section") == "peak", F.format_string("Peak period: %s with %d rows.", "label", "count"))
    order = F.when(F.col("section") == "total", 0).when(F.col("section") == "change", 1).when(F.col("section") == "peak", 2)
    for i, (section, name) in enumerate(names.items(), 3):
        is_top = (F.col("section") == section) & (F.col("position") == 1)
        text = text.when(is_top, F.format_string(f"Leading value for {name}: %s (%d rows, %.1f%%).", "label", "count", "value"))
        order = order.when(F.col("section") == section, i)
    return detail.select(order.alias("position"), text.alias("highlight")).where(F.col("highlight").isNotNull()).orderBy("position")


def field_mapping(df: DataFrame, config: Mapping[str, Any]) -> dict[str, str | None]:
    """Which columns a detailed summary uses."""
    return {
        "year_field": pick_column(df.columns, [config.get("year_field"), "year"], ignore_case=False),
        "date_field": pick_column(df.columns, [config.get("date_field"), *DATE_FIELDS[:3]], ignore_case=False),
        "primary_field": _field(df, config, "harm_field"), "secondary_field": _field(df, config, "sector_field"),
        "deployer_field": _field(df, config, "deployer_field"), "developer_field": _field(df, config, "developer_field"),
    }


ANALYSES = {
    "trend": trend, "distribution": distribution, "comparison": comparison, "summary": summary, "correlation": correlation,
    "top_n": top_n, "heatmap": heatmap, "text_sample": sample_texts, "detailed_summary": detailed_summary,
}


def run_cell(df: DataFrame, cell: Mapping[str, Any]) -> DataFrame:
    """One analysis of a spec, after its filters."""
    kind = str(cell.get("analysis_type") or "").strip().lower()
    if kind not in ANALYSES:
        raise ValueError(f"Unknown analysis type: {kind}")
    config = cell.get("config") or {}
    return ANALYSES[kind](apply_filters(df, config.get("filters") or {}), config)


def run_cells(df: DataFrame, cells: Sequence[Mapping[str, Any]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All analyses of a list, and the error text of those that cannot be built. Text-only cells are passed over."""
    results: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for cell in cells:
        name = str(cell.get("id") or "")
        if not name or (cell.get("type") == "text" and not cell.get("analysis_type")):
            continue
        try:
            results[name] = run_cell(df, cell)
        except Exception as problem:  # a cell that cannot be built must not hide the others
            errors[name] = str(problem)
    return results, errors


def cells_table(df: DataFrame, cells: Sequence[Mapping[str, Any]]) -> DataFrame:
    """All results as one long table ``(cell_id, status, record)``, each record as JSON; a failed cell is one row.

    Each cell is computed on its own and kept in the shared folder, so one that fails on the data takes no other down.
    """
    results, errors = run_cells(df, cells)
    parts = []
    for name, result in results.items():
        try:
            parts.append(cut_lineage(result.select(F.lit(name).alias("cell_id"), F.lit("success").alias("status"), F.to_json(F.struct(*[col(c) for c in result.columns])).alias("record"))))
        except Exception as problem:
            errors[name] = str(problem).splitlines()[0]
    if errors:
        parts.append(df.sparkSession.createDataFrame([(k, "error", e) for k, e in errors.items()], "cell_id string, status string, record string"))
    if not parts:
        return df.sparkSession.createDataFrame([], "cell_id string, status string, record string")
    return reduce(DataFrame.unionAll, parts)


def yearly_momentum(df: DataFrame, year: str | None = None, date: str | None = None) -> DataFrame:
    """Per year: rows, mean of the last three listed years, running total."""
    counts = A.yearly_counts(df, year, date).withColumnRenamed("count", "incidents")
    return running_sum(rolling_mean(counts, "year", "incidents", 3, "rolling_3y"), "year", "incidents", "cumulative")


def monthly_rhythm(df: DataFrame, date: str) -> DataFrame:
    """Per month: rows and mean of the last six listed months."""
    start = month_start(col(date), field_types(df)[date])
    rows = df.select(start.alias("month_start")).where(F.col("month_start").isNotNull())
    return rolling_mean(A.group_count(rows, "month_start", name="incidents"), "month_start", "incidents", 6, "rolling_6m")


def label_matrix(df: DataFrame, row: str, column: str, n: int = 10, per_side: int | None = None) -> DataFrame:
    """Label-by-label counts of two multi-valued fields, restricted to the top labels of each, zero cells included."""
    pairs = A.label_pairs(df, row, column, per_side)
    return with_zero_cells(A.crosstab(top_categories_only(pairs, [row, column], n), row, column), row, column)


def entity_links(df: DataFrame, entity: str, target: str, n_entities: int = 12, n_targets: int = 10) -> DataFrame:
    """Counts between top entities and top targets, tops taken over rows that have both."""
    both = df.where(col(entity).isNotNull() & col(target).isNotNull()).select(
        col(entity).cast("string").alias(entity), col(target).cast("string").alias(target))
    kept = top_categories_only(both, [entity], n_entities)
    top_targets = A.ranked(A.group_count(both, target), target, n_targets).select(col(target).alias("_t"))
    # at most n_targets rows
    kept = kept.join(F.broadcast(top_targets), col(target) == F.col("_t"), "left_semi")
    return A.group_count(kept, entity, target, name="value")


def facts_pack(df: DataFrame, date: str | None, fields: Mapping[str, str], n: int = 10) -> DataFrame:
    """``(section, label, count, value)``: size, date range, coverage and label lists in one table."""
    text, whole, real = "string", "bigint", "double"
    none = F.lit(None)
    parts = [df.agg(F.count(F.lit(1)).alias("c")).select(
        F.lit("size").alias("section"), F.lit("rows").alias("label"), F.col("c").alias("count"), none.cast(real).alias("value"))]
    parts.append(df.sparkSession.range(1).select(
        F.lit("size"), F.lit("columns"), F.lit(len(df.columns)).cast(whole), none.cast(real)))
    if date:
        r = A.date_range(df, date)
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        parts.append(r.select(F.inline(F.array(
            F.struct(F.lit("start").alias("s"), day("earliest").alias("l"), none.cast(whole).alias("c"), none.cast(real).alias("v")),
            F.struct(F.lit("end").alias("s"), day("latest").alias("l"), none.cast(whole).alias("c"), none.cast(real).alias("v"))))))
    parts.append(A.coverage(df, list(fields.values()), 2).select(F.lit("coverage"), "field", none.cast(whole), "coverage_pct"))
    for name, f in fields.items():
        top = A.label_counts(df, f, n, 2)
        parts.append(top.select(F.lit(f"top_{name}"), F.col("label").cast(text), F.col("count"), F.col("pct")))
    return reduce(DataFrame.unionAll, parts)
