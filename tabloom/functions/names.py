"""Functions over column and table *names*. They see the schema only, never rows."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def unique_names(names: Iterable[str], first_suffix: int = 1, sep: str = "_") -> list[str]:
    """Make names distinct by appending ``_1``, ``_2`` … (or from ``first_suffix``) to later repeats."""
    taken: set[str] = set()
    result = []
    for name in names:
        pick, n = name, first_suffix
        while pick in taken:
            pick, n = f"{name}{sep}{n}", n + 1
        taken.add(pick)
        result.append(pick)
    return result


def clean_column_name(name: str) -> str:
    """Lower-case snake form; a leading digit gets ``col_``, nothing left becomes ``unnamed``."""
    snake = "_".join(re.findall(r"[a-z0-9]+", str(name).lower().strip()))
    if not snake:
        return "unnamed"
    return f"col_{snake}" if snake[0].isdigit() else snake


def clean_column_names(names: Sequence[str]) -> list[str]:
    return unique_names(clean_column_name(n) for n in names)


def json_column_name(path: str) -> str:
    """Column name of a flattened JSON path: a dot is ``__``, anything else unusual is ``_``."""
    return re.sub(r"\W", "_", path.replace(".", "__"), flags=re.ASCII)


def incident_column_name(name: str) -> str:
    return re.sub(r"[ .]", "_", str(name).strip().lower())


def header_key(name: str) -> str:
    """Comparison form of a header: no duplicate-suffix such as ``.1``, no punctuation, lower case."""
    return re.sub(r"[^a-z0-9]+", "", re.sub(r"\.\d+$", "", str(name).strip().lower()))


def columns_matching(columns: Sequence[str], header: str) -> list[str]:
    """Every column whose comparison form equals that of ``header``."""
    return [c for c in columns if header_key(c) == header_key(header)]


def pick_column(columns: Sequence[str], candidates: Iterable[str | None], ignore_case: bool = True) -> str | None:
    """First candidate that exists, in candidate order."""
    fold = str.lower if ignore_case else str
    by_name = {fold(c): c for c in columns}
    return next((by_name[fold(c)] for c in candidates if c and fold(c) in by_name), None)


def fuzzy_column(columns: Sequence[str], aliases: Sequence[str], accept: float = 0.55, min_alias: int = 4) -> str | None:
    """Exact match on the alphanumeric form, else the best containment match by length ratio."""
    def squash(text: str) -> str:
        return re.sub(r"[^a-z0-9]+", "", str(text).lower())

    squashed = {squash(c): c for c in columns}
    wanted = [squash(a) for a in aliases if a]
    exact = next((squashed[w] for w in wanted if w in squashed), None)
    if exact is not None:
        return exact
    scored = [
        (min(len(s), len(w)) / max(len(s), len(w)), -pos, c)
        for pos, c in enumerate(columns)
        for s in [squash(c)] if s
        for w in wanted if len(w) >= min_alias and (w in s or s in w)
    ]
    if not scored:
        return None
    ratio, _, column = max(scored)
    return column if ratio >= accept else None


def table_name(relative_path: str) -> str:
    """Table name of a file: path without extension, runs of punctuation as ``_``, lower case."""
    stem = posixpath.splitext(relative_path.replace("\\", "/"))[0]
    return re.sub(r"[^a-zA-Z0-9]+", "_", stem).strip("_").lower() or posixpath.basename(stem).lower()


def table_names(relative_paths: Sequence[str]) -> list[str]:
    return unique_names((table_name(p) for p in relative_paths), first_suffix=2)


def find_table(names: Iterable[str], wanted: str) -> str | None:
    """A file by exact name, else the first whose name ends with ``wanted`` (any case)."""
    listed = list(names)
    if wanted in listed:
        return wanted
    return next((n for n in listed if n.lower().endswith(wanted.lower())), None)


def find_tables_by_prefix(paths: Iterable[str], prefix: str, suffixes: Sequence[str] = (".csv", ".json")) -> list[str]:
    """Files whose base name starts with ``prefix``; CSV and JSON only."""
    start = prefix.strip().lower()
    return [
        p for p in dict.fromkeys(paths)
        if posixpath.basename(p).lower().startswith(start) and p.lower().endswith(tuple(suffixes))
    ]


def name_tokens(name: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9]+", name.lower())))


def rename_clean(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_column_names(df.columns))


def rename_incident(df: DataFrame) -> DataFrame:
    return df.toDF(*(incident_column_name(c) for c in df.columns))


def rename_json(df: DataFrame) -> DataFrame:
    return df.toDF(*(json_column_name(c) for c in df.columns))


def humanised(column: str | None) -> str:
    """A column name as a heading: words for underscores, the first letter raised; empty for none."""
    words = " ".join((column or "").split("_")).strip()
    return words[:1].upper() + words[1:]
