"""Encoders that are fitted on one table, stored, and applied to others: one-hot, ordinal, frequency, target mean, date parts.

Values are compared as text. Columns of few values (one-hot, ordinal) are held as lists of at most MAX_LABELS labels and become
expressions; columns of any number of values (frequency, target mean) stay a table that is joined. One aggregate over stacked
values fits them all, so a value that fills a third of the rows is one partial sum per task.

Defined cases: a null value has null codes, but all zeros in one-hot columns; a value not seen when fitting has code -1, share 0,
zeros, or the prior mean; a null target counts nowhere; an empty table has null means. Rows are neither lost nor repeated.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import stable_token
from ..session import cut_lineage
from .cleaning import ENCODERS, encoder_suggestions
from .shape import col, field_types, melt_text, small_table

MAX_LABELS = 1000
SMOOTHING = 10.0  # weight of the prior mean, in rows
METHODS = {ENCODERS["few"]: "one_hot", ENCODERS["some"]: "ordinal", ENCODERS["many"]: "frequency", ENCODERS["datetime"]: "date_parts"}
FITTED = "column string, method string, place int, value string, share double, means array<double>"


def plan_encoders(df: DataFrame, roles: Mapping[str, str], target: str | None = None) -> dict[str, str]:
    """``{column: method}`` from the suggestions. Columns of many values get target means if there is a target, otherwise
    frequencies; free text gets nothing."""
    found = {r["column"]: METHODS.get(r["suggestion"]) for r in encoder_suggestions(df, roles).collect()}
    many = "frequency" if target is None else "target"
    return {c: many if found[c] == "frequency" else found[c] for c in df.columns if found.get(c) and c != target}


@dataclass(frozen=True)
class FittedEncoders:
    """``methods`` and ``labels`` of few-valued columns; ``wide`` is ``(column, value, share, means)``, where a null value holds the
    prior means: one per fold without that fold, the mean over all rows last."""

    methods: Mapping[str, str]
    labels: Mapping[str, tuple[str, ...]]
    wide: DataFrame

    def outputs(self, column: str) -> list[str]:
        method = self.methods[column]
        if method == "one_hot":
            return [f"{column}_is_{k}" for k in range(len(self.labels[column]))]
        if method == "date_parts":
            return [f"{column}_{part}" for part in ("year", "month", "day", "weekday", "is_weekend")]
        return [f"{column}_{ {'ordinal': 'code', 'frequency': 'share', 'target': 'target'}[method]}"]

    def transform(self, df: DataFrame, fold: Column | None = None) -> DataFrame:
        """``df`` with the coded columns added. With ``fold``, as given when fitting, target means leave out the row's own fold;
        without it they are over all rows, as for rows not fitted on."""
        types = field_types(df)
        new = [o for c in self.methods for o in self.outputs(c)]
        if clash := sorted({*new} & {*df.columns}) or sorted({o for o in new if new.count(o) > 1}):
            raise ValueError(f"columns are there already: {', '.join(clash)}")
        coded: dict[str, Column] = {}
        for c, method in self.methods.items():
            text = stable_token(col(c), types[c])
            if method == "one_hot":
                coded |= {o: F.coalesce(text == F.lit(label), F.lit(False)).cast("int") for o, label in zip(self.outputs(c), self.labels[c])}
            elif method == "ordinal":
                place = F.array_position(F.array(*map(F.lit, self.labels[c])), text) if self.labels[c] else F.lit(0)
                coded[self.outputs(c)[0]] = F.when(text.isNotNull(), (place - 1).cast("int"))
            elif method == "date_parts":
                weekday = F.weekday(col(c))
                coded |= dict(zip(self.outputs(c), (F.year(col(c)), F.month(col(c)), F.dayofmonth(col(c)), weekday, (weekday >= 5).cast("int"))))
        out = df.withColumns(coded) if coded else df
        for c, method in self.methods.items():
            if method in ("frequency", "target"):
                out = self._joined(out, c, method, fold, stable_token(col(c), types[c]))
        return out.select(*[col(c) for c in df.columns], *[col(o) for o in new])

    def _joined(self, out: DataFrame, c: str, method: str, fold: Column | None, text: Column) -> DataFrame:
        """One value has one row, so a left join keeps the rows as they are and adaptive execution can split a hot value."""
        mine = self.wide.where(F.col("column") == c)
        codes = mine.where("value is not null").select(F.col("value").alias("_enc_value"), F.col("share").alias("_enc_share"), F.col("means").alias("_enc_means"))
        name, known = self.outputs(c)[0], text.isNotNull()
        if method == "frequency":
            return out.join(codes, text == F.col("_enc_value"), "left").withColumn(
                name, F.when(known, F.coalesce("_enc_share", F.lit(0.0)))).drop(*codes.columns)
        prior = mine.where("value is null").agg(F.first("means").alias("means")).scalar()
        means = F.coalesce(F.col("_enc_means"), prior)
        at = F.size(means) - 1 if fold is None else fold.cast("int")
        return out.join(codes, text == F.col("_enc_value"), "left").withColumn(name, F.when(known, F.get(means, at))).drop(*codes.columns)

    def table(self) -> DataFrame:
        """Everything as one table, as it is stored."""
        rows = [(c, m, k, v) for c, m in self.methods.items() for k, v in enumerate(self.labels.get(c) or [None])]
        few = small_table(self.wide.sparkSession, rows, "column string, method string, place int, value string")
        few = few.select("*", F.lit(None).cast("double").alias("share"), F.lit(None).cast("array<double>").alias("means"))
        return few.unionByName(self.wide.select("column", F.lit("").alias("method"), F.lit(-1).alias("place"), "value", "share", "means"))

    def save(self, path: str) -> None:
        self.table().write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedEncoders:
        table = spark.read.schema(FITTED).parquet(path)
        rows = sorted(table.where("place >= 0").select("column", "method", "place", "value").collect(), key=lambda r: r["place"])
        methods = {r["column"]: r["method"] for r in rows}
        labels = {c: tuple(r["value"] for r in rows if r["column"] == c and r["value"] is not None) for c, m in methods.items() if m in ("one_hot", "ordinal")}
        return FittedEncoders(methods, labels, table.where("place < 0").select("column", "value", "share", "means"))


def _labels(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, ...]]:
    if not columns:
        return {}
    # a column beyond the bound shows as its MAX_LABELS + 1 least values; which raises
    distinct = [df.select(F.lit(c).alias("column"), stable_token(col(c), field_types(df)[c]).alias("value")).where("value is not null")
                .distinct().orderBy("value").limit(MAX_LABELS + 1) for c in columns]
    both = distinct[0]
    for other in distinct[1:]:
        both = both.unionAll(other)
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in both.collect():
        found[r["column"]].append(r["value"])
    if wide := [c for c in columns if len(found[c]) > MAX_LABELS]:
        raise ValueError(f"more than {MAX_LABELS} values, use frequency or target: {', '.join(wide)}")
    return {c: tuple(sorted(v)) for c, v in found.items()}


def _wide(df: DataFrame, columns: list[str], target: str | None, fold: Column | None, folds: int, smoothing: float) -> DataFrame:
    y = col(target).cast("double") if target else F.lit(None).cast("double")
    part = fold.cast("int") if fold is not None else F.lit(0)
    rows = df.select(*[stable_token(col(c), field_types(df)[c]).alias(c) for c in columns], F.nanvl(y, F.lit(None)).alias("_enc_y"), part.alias("_enc_fold"))
    cells = melt_text(rows, columns, keep=["_enc_y", "_enc_fold"])
    parts = range(folds if fold is not None else 0)
    own = [f(F.when(F.col("_enc_fold") == k, F.col("_enc_y"))).alias(f"{n}{k}") for k in parts for n, f in (("t", F.sum), ("n", F.count))]
    sums = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"), F.sum("_enc_y").alias("t"), F.count("_enc_y").alias("n"), *own)
    sums = cut_lineage(sums)
    names = ["t", "n", *[f"{n}{k}" for k in parts for n in "tn"]]
    whole = sums.groupBy("column").agg(F.sum("rows").alias("all_rows"), *[F.sum(n).alias(f"all_{n}") for n in names])

    def without(k: int | None, prefix: str = "") -> tuple[Column, Column]:
        total, count = F.coalesce(F.col(f"{prefix}t"), F.lit(0.0)), F.col(f"{prefix}n")
        return (total, count) if k is None else (total - F.coalesce(F.col(f"{prefix}t{k}"), F.lit(0.0)), count - F.col(f"{prefix}n{k}"))

    priors = [F.try_divide(*without(k, "all_")) for k in (*parts, None)]
    means = [F.try_divide(without(k)[0] + smoothing * p, without(k)[1] + smoothing) for k, p in zip((*parts, None), priors)]
    # one row per column
    codes = sums.where("value is not null").join(F.broadcast(whole), "column").select(
        "column", "value", (F.col("rows") / F.col("all_rows")).alias("share"), F.array(*means).alias("means"))
    return cut_lineage(codes.unionByName(whole.select("column", F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("share"), F.array(*priors).alias("means"))))


def fit_encoders(
    df: DataFrame, plan: Mapping[str, str], target: str | None = None, fold: Column | None = None, folds: int = 5, smoothing: float = SMOOTHING,
) -> FittedEncoders:
    """Encoders of ``{column: one_hot, ordinal, frequency, target or date_parts}``. ``fold`` numbers the rows 0 to folds - 1 by
    something that stays with a row, as its id does, so that training rows can be coded without their own target."""
    if unknown := {*plan.values()} - {"one_hot", "ordinal", "frequency", "target", "date_parts"}:
        raise ValueError(f"unknown encoders: {', '.join(sorted(unknown))}")
    if "target" in plan.values() and target is None:
        raise ValueError("target means need a target column")
    wide = [c for c, m in plan.items() if m in ("frequency", "target")]
    empty = "column string, value string, share double, means array<double>"
    codes = _wide(df, wide, target, fold, folds, smoothing) if wide else df.sparkSession.createDataFrame([], empty)
    return FittedEncoders(dict(plan), _labels(df, [c for c, m in plan.items() if m in ("one_hot", "ordinal")]), codes)
