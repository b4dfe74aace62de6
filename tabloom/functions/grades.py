"""Severity grades of profile figures, as plain labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def null_grade(share: Column) -> Column:
    return F.when(share > 0.30, "critical").when(share >= 0.05, "warning").otherwise("ok")


def outlier_grade(share: Column) -> Column:
    return F.when(share > 0.10, "critical").when(share >= 0.01, "warning").otherwise("ok")


def quality_grade(score: Column) -> Column:
    return F.when(score >= 91, "excellent").when(score >= 71, "good").when(score >= 41, "fair").otherwise("poor")


def correlation_grade(r: Column) -> Column:
    return F.when(F.abs(r) > 0.95, "severe").when(F.abs(r) >= 0.85, "high").otherwise("ok")


def imbalance_grade(ratio: Column) -> Column:
    """``ratio`` is largest class over smallest class."""
    return F.when(ratio > 10, "severe").when(ratio >= 3, "moderate").otherwise("balanced")
