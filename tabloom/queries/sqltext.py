"""SQL fragments used by the checks: the same rules as the functions package, written for a SQL engine."""

from __future__ import annotations

PLACEHOLDER_LIST = "'', '--', '-', 'na', 'n/a', 'nan', 'none', 'null', 'false', 'yes', 'no', 'maybe', '[]', '{}'"
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(e: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({e}), '{NUMBER_PATTERN}') THEN try_cast(trim({e}) AS DOUBLE) END)"


def date(e: str) -> str:
    s = f"trim({e})"
    month_names = r"(?i)\d{1,2}\s+[a-z]{3,9}\s+\d{4}"
    names_first = r"(?i)[a-z]{3,9}\s+\d{1,2}\s+\d{4}"
    parsed = f"""(CASE
      WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}|\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN try_strptime({s}, ['%Y-%m-%d', '%Y/%m/%d'])
      WHEN regexp_full_match({s}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}')
        THEN coalesce(try_strptime({s}, ['%d-%m-%Y', '%d/%m/%Y']), try_strptime({s}, ['%m-%d-%Y', '%m/%d/%Y']))
      WHEN regexp_full_match({s}, '\\d{{8}}') THEN try_strptime({s}, '%Y%m%d')
      WHEN regexp_full_match({s}, '{month_names}') THEN try_strptime({s}, ['%d %b %Y', '%d %B %Y'])
      WHEN regexp_full_match({s}, '{names_first}') THEN try_strptime({s}, ['%b %d %Y', '%B %d %Y'])
      WHEN regexp_full_match({s}, '\\d{{4}}') THEN try_cast({s} || '-01-01' AS TIMESTAMP)
      WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{1,2}}') THEN try_cast({s} || '-01' AS TIMESTAMP)
      WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}[ T]') THEN try_cast({s} AS TIMESTAMP)
    END)"""
    return f"(CASE WHEN NOT regexp_full_match({s}, '\\d{{4}}|\\d{{8}}') OR year({parsed}) BETWEEN 1678 AND 2261 THEN CAST({parsed} AS DATE) END)"


def fold(e: str) -> str:
    return f"regexp_replace(strip_accents({e}), '[^\\x00-\\x7f]', '', 'g')"


def key(e: str, strategy: str) -> str:
    """``e`` is the value's text."""
    return {
        "exact": e,
        "casefold": f"nullif(lower(trim(regexp_replace({fold(e)}, '\\s+', ' ', 'g'))), '')",
        "slug": f"nullif(regexp_replace(lower({fold(e)}), '[^a-z0-9]', '', 'g'), '')",
        "id_strip": f"(CASE WHEN regexp_replace({e}, '[^0-9]', '', 'g') <> '' THEN coalesce(nullif(ltrim(regexp_replace({e}, '[^0-9]', '', 'g'), '0'), ''), '0') END)",
        "numeric": f"(SELECT CASE WHEN d = trunc(d) AND abs(d) < 1e15 THEN CAST(CAST(d AS BIGINT) AS VARCHAR) ELSE CAST(d AS VARCHAR) END FROM (SELECT {number(f'replace({e}, $$,$$, $$$$)')} AS d))",
        "date": f"strftime({date(e)}, '%Y-%m-%d')",
    }[strategy]


def even(e: str, digits: int) -> str:
    """Round half to even on the scaled double."""
    scale = 10 ** digits
    return f"(CAST(round_even(CAST({e} AS DOUBLE) * {scale}.0, 0) AS DOUBLE) / {scale}.0)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
