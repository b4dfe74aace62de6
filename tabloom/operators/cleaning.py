"""Cleaning steps. Each takes (DataFrame, Context) and gives a lazy DataFrame with log entries and warnings.

Decisions (roles, types, fill values, outlier figures) come from one statistics gather per step over all rows; the driver
only ever holds a few numbers per column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from ..functions.dates import parse_date, parse_timestamp
from ..functions.names import clean_column_names
from ..functions.text import EMPTY_WORDS, FALSE_WORDS, TRUE_WORDS, strip, to_boolean, to_number
from ..session import cut_lineage
from ..sources.sinks import log_frame
from .aggregates import distinct_counts, duplicate_rows, modes, null_counts
from .profile import number_figures
from .quantiles import column_quantiles
from .rows import domain_anomalies
from .shape import MOMENT, NESTED, col, field_types, numeric_columns, without_nan
from .windows import forward_fill

# Role vocabulary of known columns per domain.
ROLES = ("id_col", "datetime_col", "target_col", "feature_col", "text_col", "constant_col")
ROLE_WORDS = {
    "id": "id_col", "text": "text_col", "datetime": "datetime_col", "feature": "feature_col", "categorical": "feature_col",
    "target": "target_col", "constant": "constant_col",
}
DOMAINS = ("general", "healthcare", "finance", "education", "ecommerce", "ai_incidents", "other")
KNOWN_COLUMNS = {
    "ai_incidents": {
        "incident_id": "id", "title": "text", "description": "text", "date": "datetime", "year": "feature",
        "allegeddeployerofaisystem": "categorical", "allegeddeveloperofaisystem": "categorical",
        "allegedharmedornearlyharmedparties": "categorical", "allegedharmedornearlyharmeddparties": "categorical",
        "harm_type": "categorical", "sector_of_deployment": "categorical", "technology_purveyor": "categorical",
        "ai_system": "categorical",
    },
}
UNIQUE_ID_SHARE, DATE_TEXT_SHARE, LONG_TEXT = 0.95, 0.80, 50
WARN_NULL_SHARE, FLAG_NULL_SHARE = 0.30, 0.05
OUTLIER_MIN_ROWS, NORMAL_P, Z_LIMIT, OUTLIER_WARN_SHARE = 10, 0.05, 3.5, 0.05
NORMALITY_MIN_ROWS = 20


@dataclass(frozen=True)
class Context:
    """Inputs of a cleaning run. ``roles`` maps columns to roles and is filled by role inference."""

    domain: str = "general"
    job_id: str = "job"
    roles: Mapping[str, str] = field(default_factory=dict)
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    strict_parity: bool = True
    checkpoint: bool = False  # write typed and filled rows to the shared folder, so later steps need not redo earlier ones


@dataclass(frozen=True)
class StepResult:
    df: DataFrame
    context: Context
    logs: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)

    def log_frame(self) -> DataFrame:
        return log_frame(self.df.sparkSession, self.logs)


def _entry(ctx: Context, step: str, action: str, column: str | None = None, severity: str = "info", **after) -> dict:
    return {"job_id": ctx.job_id, "step_name": step, "action": action, "column_name": column,
            "after_value": after or None, "severity": severity}


def normalize_columns(df: DataFrame, ctx: Context) -> StepResult:
    new = clean_column_names(df.columns)
    changed = [(a, b) for a, b in zip(df.columns, new) if a != b]
    logs = [_entry(ctx, "ColumnNormalizer", "rename_column", a, new_name=b) for a, b in changed]
    renamed = dict(zip(df.columns, new))
    roles = {renamed.get(c, c): r for c, r in ctx.roles.items()}
    order = lambda names: tuple(renamed.get(n, n) for n in names)
    ctx = replace(ctx, roles=roles, order_by=order(ctx.order_by), partition_by=order(ctx.partition_by))
    return StepResult(df.toDF(*new), ctx, logs, [], [b for _, b in changed])


def role_figures(df: DataFrame) -> DataFrame:
    """``(column, rows, distinct, date_share, mean_length)``; text figures are null for other types."""
    texts = [c for c, t in field_types(df).items() if isinstance(t, T.StringType)]
    base = distinct_counts(df).withColumn("rows", df.agg(F.count(F.lit(1))).scalar())
    if not texts:
        return base.select("column", "rows", "n_distinct", F.lit(None).cast("double").alias("date_share"),
                           F.lit(None).cast("double").alias("mean_length"))
    cells = df.select(*[col(c) for c in texts]).unpivot([], [col(c) for c in texts], "column", "value")
    looks = cells.where(F.col("value").isNotNull()).groupBy("column").agg(
        F.avg(parse_date(F.col("value")).isNotNull().cast("int")).alias("date_share"),
        F.avg(F.length("value")).alias("mean_length"))
    return base.join(looks, "column", "left").select("column", "rows", "n_distinct", "date_share", "mean_length")


def role_of(name: str, dtype: T.DataType, figures: Row) -> str:
    """Role of one column from its figures. A nearly unique column is looked at no further."""
    rows, distinct = figures.rows, figures.n_distinct
    if rows and distinct == 1:
        return "constant_col"
    if rows and distinct / rows > UNIQUE_ID_SHARE:
        named = any(word in name.lower() for word in ("id", "key", "uuid"))
        return "id_col" if named or isinstance(dtype, T.IntegralType) else "feature_col"
    if isinstance(dtype, T.StringType):
        if (figures.date_share or 0.0) > DATE_TEXT_SHARE:
            return "datetime_col"
        return "text_col" if (figures.mean_length or 0.0) > LONG_TEXT else "feature_col"
    return "datetime_col" if isinstance(dtype, MOMENT) else "feature_col"


def infer_roles(df: DataFrame, ctx: Context) -> StepResult:
    known = {c: ROLE_WORDS.get(w, w) for c, w in KNOWN_COLUMNS.get(ctx.domain, {}).items()}
    types = field_types(df)
    open_columns = [c for c in df.columns if c not in known]
    figures = {r.column: r for r in role_figures(df.select(*[col(c) for c in open_columns])).collect()} if open_columns else {}
    roles, logs, warnings = dict(ctx.roles), [], []
    for c in df.columns:
        if c in known:
            roles[c] = known[c]
            logs.append(_entry(ctx, "SchemaAnalyzer", "role_assignment", c, role=known[c], source="domain_profile"))
            continue
        roles[c] = role_of(c, types[c], figures[c])
        if roles[c] == "constant_col":
            warnings.append(f"{c}: one value in all rows; consider dropping it")
        logs.append(_entry(ctx, "SchemaAnalyzer", "role_assignment", c, role=roles[c]))
    tagged = df.select(*[col(c).alias(c, metadata={**df.schema[c].metadata, "role": roles[c]}) for c in df.columns])
    return StepResult(tagged, replace(ctx, roles=roles), logs, warnings)


def type_figures(df: DataFrame) -> DataFrame:
    """``(column, n, numeric_share, boolean_share)`` of text columns, after trimming."""
    texts = [c for c, t in field_types(df).items() if isinstance(t, T.StringType)]
    cells = df.select(*[strip(col(c)).alias(c) for c in texts]).unpivot([], [col(c) for c in texts], "column", "value")
    value = F.col("value")
    return cells.groupBy("column").agg(
        F.count("value").alias("n"),
        F.avg(F.when(value.isNotNull(), to_number(value).isNotNull().cast("int"))).alias("numeric_share"),
        F.avg(F.lower(value).isin(TRUE_WORDS + FALSE_WORDS + EMPTY_WORDS).cast("int")).alias("boolean_share"),
    )


def fix_types(df: DataFrame, ctx: Context) -> StepResult:
    """Trim text; make mostly numeric text numeric, yes/no text boolean, and date-role text timestamps.

    With ``strict_parity`` a column that is numeric in *every* row stays text, as the established rule has it.
    """
    texts = [c for c, t in field_types(df).items() if isinstance(t, T.StringType)]
    if not texts:
        return StepResult(df, ctx)
    figures = {r.column: r for r in type_figures(df).collect()}
    casts: dict[str, Column] = {}
    logs, modified = [], []
    for c in texts:
        trimmed, f = strip(col(c)), figures.get(c)
        casts[c] = trimmed
        if f is None or not f.n:
            continue
        numeric = f.numeric_share > 0.95 and (f.numeric_share < 1.0 or not ctx.strict_parity)
        if numeric:
            casts[c] = to_number(trimmed)
            logs.append(_entry(ctx, "TypeFixer", "coerce_numeric", c))
        elif f.boolean_share == 1.0:
            casts[c] = to_boolean(trimmed)
            logs.append(_entry(ctx, "TypeFixer", "coerce_boolean", c))
        elif ctx.roles.get(c) == "datetime_col":
            casts[c] = parse_timestamp(trimmed)
        else:
            continue
        modified.append(c)
    meta = {c: df.schema[c].metadata for c in df.columns}
    out = df.select(*[casts.get(c, col(c)).alias(c, metadata=meta[c]) for c in df.columns])
    return StepResult(out, ctx, logs, [], modified)


def fill_missing(df: DataFrame, ctx: Context) -> StepResult:
    """Fill columns with at most 30 % nulls: numbers by the median, dates forward, the rest by the mode.

    From 5 % nulls on a 0/1 column records what was missing. Above 30 % there is only a warning.
    """
    df = without_nan(df)
    types = field_types(df)
    shares = {r.column: r.null_pct for r in null_counts(df).collect() if r.null_count}
    warnings = [f"{c}: {p:.1%} of the values are missing, too many to fill"
                for c, p in shares.items() if p > WARN_NULL_SHARE]
    fill = [c for c in df.columns if 0 < shares.get(c, 0) <= WARN_NULL_SHARE]
    if not fill:
        return StepResult(df, ctx, [], warnings)

    def method(c: str) -> str:
        role = ctx.roles.get(c, "feature_col")
        if isinstance(types[c], T.NumericType) and role != "id_col":
            return "median"
        return "ffill" if role == "datetime_col" or isinstance(types[c], MOMENT) else "mode"

    how = {c: method(c) for c in fill}
    by = lambda m: [c for c in fill if how[c] == m]
    values: dict[str, object] = {}
    if by("median"):
        values.update({r.column: r.quantile for r in column_quantiles(df, by("median"), [0.5]).collect()})
    if by("mode"):
        found = {r.column: r.mode for r in modes(df, by("mode")).collect()}
        values.update({c: found.get(c) if found.get(c) is not None else "Missing" for c in by("mode")})

    flagged = [c for c in fill if shares[c] >= FLAG_NULL_SHARE]
    out = df.withColumns({f"{c}_was_missing": col(c).isNull().cast("int") for c in flagged}) if flagged else df
    filled = {}
    for c in by("median"):
        value = values[c]
        # a whole-number column keeps its type unless the median falls between two values
        kind = types[c] if not isinstance(types[c], T.IntegralType) or float(value).is_integer() else T.DoubleType()
        filled[c] = F.coalesce(col(c).cast(kind), F.lit(value).cast(kind))
    for c in by("mode"):
        if not isinstance(types[c], NESTED):
            filled[c] = F.coalesce(col(c), F.lit(values[c]).try_cast(types[c]))
    out = out.withColumns(filled) if filled else out
    if by("ffill"):
        out = forward_fill(out, by("ffill"), ctx.order_by, ctx.partition_by)

    logs, modified = [], []
    for c in fill:
        if c in flagged:
            logs.append(_entry(ctx, "MissingHandler", "add_indicator", c))
            modified.append(f"{c}_was_missing")
        logs.append(_entry(ctx, "MissingHandler", "impute", c, method=how[c], fill_val=str(values.get(c))))
        modified.append(c)
    return StepResult(out, ctx, logs, warnings, modified)


def flag_duplicates(df: DataFrame, ctx: Context) -> StepResult:
    """Report exact duplicate rows; none is removed."""
    found = duplicate_rows(df).first()
    if not found.duplicates:
        return StepResult(df, ctx)
    entry = _entry(ctx, "DuplicateDetector", "flag_duplicates", severity="warning", dup_count=found.duplicates)
    return StepResult(df, ctx, [entry], [f"{found.duplicates} rows ({found.duplicate_pct:.2%}) repeat another row"])


def skew_z(n: Column, g1: Column) -> Column:
    """Normal score of a population skewness (D'Agostino 1970)."""
    y = F.when(g1 == 0, 1.0).otherwise(g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    return F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))


def kurtosis_z(n: Column, b2: Column) -> Column:
    """Normal score of a population, non-excess kurtosis (Anscombe and Glynn 1983)."""
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(d) * F.pow(F.try_divide(1 - 2 / a, F.abs(d)), F.lit(1 / 3))
    return (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))


def normality_p(n: Column, g1: Column, b2: Column) -> Column:
    """p-value of the K2 test: both scores squared, chi-square with two degrees of freedom."""
    z1, z2 = skew_z(n, g1), kurtosis_z(n, b2)
    return F.exp(-(z1 * z1 + z2 * z2) / 2)


def outlier_figures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n, method, outlier_count, outlier_pct)`` of numeric columns.

    Columns that look normal are judged by z-score with the population deviation, all others by quartile fences.
    """
    figures = number_figures(df, columns, z_limit=Z_LIMIT).where(F.col("n") >= OUTLIER_MIN_ROWS)
    n = F.col("n").cast("double")
    p = F.when((n >= NORMALITY_MIN_ROWS) & (F.col("sd_pop") > 0), normality_p(n, F.col("g1"), F.col("g2") + 3))
    out = figures.withColumn("normal", F.coalesce(p > NORMAL_P, F.lit(False)))
    count = F.when(F.col("normal"), F.col("z_count")).otherwise(F.col("outlier_count"))
    return out.select("column", "n", F.when(F.col("normal"), "Z-Score").otherwise("IQR").alias("method"),
                      count.alias("outlier_count"), F.round(count / F.col("n"), 4).alias("outlier_pct"))


def flag_outliers(df: DataFrame, ctx: Context) -> StepResult:
    """Report outliers and domain anomalies; no value is changed."""
    columns = [c for c in numeric_columns(df) if ctx.roles.get(c) not in ("id_col", "datetime_col")]
    if not columns:
        return StepResult(df, ctx)
    anomalies = domain_anomalies(df, ctx.domain, columns).collect()
    figures = {r.column: r for r in outlier_figures(df, columns).collect()}
    warnings = [f"{ctx.domain.capitalize()} anomaly: {a.column}: {a.warning}." for a in anomalies if a.column in figures]
    logs = [
        _entry(ctx, "OutlierDetector", "flag_outliers", c, "warning" if f.outlier_count / f.n > OUTLIER_WARN_SHARE else "info",
               count=f.outlier_count, pct=f.outlier_pct, method=f.method)
        for c in columns for f in [figures.get(c)] if f is not None and f.outlier_count
    ]
    return StepResult(df, ctx, logs, warnings)


# Suggestion texts.
ENCODERS = {
    "datetime": "feature_extraction (year, month, day, weekday, is_weekend)",
    "text": "TF-IDF or Embeddings",
    "few": "One-Hot Encoding",
    "some": "Label/Ordinal Encoding",
    "many": "Target/Frequency Encoding",
}


def encoder_suggestions(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """``(column, suggestion)`` from role and number of distinct values."""
    types = field_types(df)
    open_columns = [c for c in df.columns if roles.get(c) not in ("id_col", "constant_col", "target_col")]
    by_role = [(c, ENCODERS["datetime"] if roles.get(c) == "datetime_col" else ENCODERS["text"])
               for c in open_columns if roles.get(c) in ("datetime_col", "text_col")]
    counted = [c for c in open_columns if roles.get(c) not in ("datetime_col", "text_col") and isinstance(types[c], (T.StringType, *NESTED))]
    parts = df.sparkSession.createDataFrame(by_role, "column string, suggestion string")
    if not counted:
        return parts
    n = F.col("n_distinct")
    label = F.when(n <= 10, ENCODERS["few"]).when(n <= 50, ENCODERS["some"]).otherwise(ENCODERS["many"])
    return parts.unionAll(distinct_counts(df, counted).select("column", label.alias("suggestion")))


def suggest_encoders(df: DataFrame, ctx: Context) -> StepResult:
    found = {r.column: r.suggestion for r in encoder_suggestions(df, ctx.roles).collect()}
    logs = [_entry(ctx, "EncoderSuggester", "suggest_encoder", c, suggestion=found[c]) for c in df.columns if c in found]
    return StepResult(df, ctx, logs)


STEPS: tuple[Callable[[DataFrame, Context], StepResult], ...] = (
    normalize_columns, infer_roles, fix_types, fill_missing, flag_duplicates, flag_outliers, suggest_encoders,
)


def clean(df: DataFrame, ctx: Context | None = None, steps: Sequence[Callable] = STEPS) -> StepResult:
    """All cleaning steps in their fixed order; logs and warnings are concatenated, a failing step aborts."""
    result = StepResult(without_nan(df), ctx or Context())
    logs, warnings, modified = [], [], []
    for step in steps:
        try:
            result = step(result.df, result.context)
        except Exception as problem:
            raise RuntimeError(f"Cleaning step {step.__name__} failed: {problem}") from problem
        logs += result.logs
        warnings += result.warnings
        modified += result.modified
        if result.context.checkpoint and step in (fix_types, fill_missing) and result.modified:
            result = replace(result, df=cut_lineage(result.df))
    return StepResult(result.df, result.context, logs, warnings, list(dict.fromkeys(modified)))
