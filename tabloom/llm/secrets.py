"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a Parquet table that only grows, holds per
blob which rules in which version looked at it and what they found; a scan reads a blob's text once, only where a pair of blob
and rule version is not in the ledger yet, and its findings are joined back to all paths and versions with that content. A
changed rule gets a new version and is the only one to run again; findings of versions no longer in force stay in the ledger
and out of the result.

Only digests are compared with the ledger. Texts move for unseen blobs alone: copies are dropped in each task before that, so a
content that a third of all rows share is scanned once and is never one task's load. A ledger row is whole for its blob: a scan
that dies leaves nothing or complete rows, and running it again does the rest.

Rules of the fixed list ``BASE`` always run; ``MORE`` widen the same kinds: keys of other issuers, further names in
assignments, digests in capitals.

Defined cases: a null text has no content address, is not scanned and finds nothing, as an empty one does; equal texts share
their findings; repeated rows have equal results; very long texts are scanned whole; null paths are kept; an empty history
gives an empty result; other columns are not read. A span that several rules of a kind find is one span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .graph import split_join
from .rows import cut_lineage, map_batches

KINDS = ("assign", "access", "hex")
LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:long,stop:long>>"
FEW = 200_000  # digests (7 MB) up to which unseen blobs are told to all tasks


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds places; a place counts where the named group ``value`` (or all) has ``least`` characters and, if
    ``mixed``, a digit and a letter. ``hints`` are strings one of which every place holds, in lower case."""

    name: str
    version: int
    kind: str
    pattern: str
    least: int
    hints: tuple[str, ...] = ()
    mixed: bool = False
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII))

    @property
    def code(self) -> str:
        return f"{self.name}@{self.version}"

    def places(self, text: str, lowered: str) -> Iterator[tuple[int, int]]:
        if self.hints and not any(h in lowered for h in self.hints):
            return
        for m in self.compiled.finditer(text):
            value = m["value"] if "value" in self.compiled.groupindex else m[0]
            if len(value) >= self.least and not (self.mixed and (value.isalpha() or value.isdigit())):
                yield m.start(), m.end()


# The base rules.
ASSIGNED = r"""["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, "assign", r"(?i:password|passwd|secret|token|api_?key)" + ASSIGNED, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, "access", r"AKIA[A-Z0-9]+", 20, ("akia",)),
    Rule("hex", 1, "hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("assign_names", 1, "assign", r"(?i:pwd|passphrase|credentials?|private_?key|access_?key|auth_?key)" + ASSIGNED, 8,
         ("pwd", "passphrase", "credential", "private", "access", "auth"), True),
    Rule("access_issuers", 1, "access", r"(?<![A-Za-z0-9])(?:gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|ASIA[A-Z0-9]{16,})", 1,
         ("gh", "xox", "sk_live_", "aiza", "asia")),
    Rule("hex_capitals", 1, "hex", r"(?<![0-9A-Za-z])[0-9A-F]{32,}(?![0-9A-Za-z])", 32, (), True),
)
RULES = BASE + MORE


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of blobs (blob, text, seen): the rules that are not in ``seen`` run."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for blob, text, seen in rows:
            lowered = text.lower()
            due = [r for r in rules if r.code not in seen]
            yield blob, [r.code for r in due], [{"rule": r.code, "start": a, "stop": b} for r in due for a, b in r.places(text, lowered)]

    return map_batches(blobs.select("blob", "text", "seen"), LEDGER, run)


def known(spark, ledger: str) -> DataFrame:
    """blob, seen (rule versions) and findings of all scans so far."""
    rows = spark.read.schema(LEDGER).parquet(ledger)
    return rows.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"), F.flatten(F.collect_list("findings")).alias("findings"))


def update(history: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> int:
    """Scans what the ledger does not hold and appends it; the number of blobs scanned."""
    spark = history.sparkSession
    spark.createDataFrame([], LEDGER).coalesce(1).write.mode("append").parquet(ledger)  # makes a ledger where there is none
    versions = history.where(F.col(text_col).isNotNull()).select(address(text_col).alias("blob"), F.col(text_col).alias("text"))
    codes = F.array(*[F.lit(r.code) for r in rules])
    none = F.array().cast("array<string>")
    unseen = versions.select("blob").distinct().join(known(spark, ledger).select("blob", "seen"), "blob", "left")
    unseen = cut_lineage(unseen.select("blob", F.coalesce("seen", none).alias("seen")).where(F.size(F.array_except(codes, "seen")) > 0))
    n = unseen.count()
    if n:
        if n <= FEW:
            # few new blobs: their texts are picked out where they are
            texts = versions.join(F.broadcast(unseen), "blob").dropDuplicates(["blob"])
        else:
            texts = versions.dropDuplicates(["blob"]).join(unseen, "blob")
        scanned(texts, rules).write.mode("append").parquet(ledger)
    return n


def address(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))


def scan(history: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The path columns, blob, and findings (kind, rule, start, stop; in code points, stop exclusive) of every row of the
    history, by start, kind as listed, stop and rule. Without a ledger a new one is made in the shared folder."""
    ledger = ledger or scratch_path(history.sparkSession, "ledger")
    update(history, ledger, rules, text_col)
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.code, r.kind)])
    in_force = F.filter("findings", lambda f: f["rule"].isin(*[r.code for r in rules]))
    item = lambda f: F.struct(f["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), kinds[f["rule"]]).alias("place"), f["stop"].alias("stop"), f["rule"].alias("rule"))
    ordered = F.transform(F.array_sort(F.array_distinct(F.transform(in_force, item))), lambda f: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), f["place"].cast("int")).alias("kind"), f["rule"].alias("rule"), f["start"].alias("start"), f["stop"].alias("stop")))
    found = known(history.sparkSession, ledger).where(F.size("findings") > 0).select("blob", ordered.alias("findings"))
    paths = history.select(*[F.col(c).alias(f"_p{k}") for k, c in enumerate(path_cols)], address(text_col).alias("blob"))
    out = split_join(paths, found, "blob", "left")
    none = F.array().cast(found.schema["findings"].dataType)
    return out.select(*[F.col(f"_p{k}").alias(c) for k, c in enumerate(path_cols)], "blob", F.coalesce("findings", none).alias("findings"))


def spans(rules: tuple[Rule, ...] | None = None) -> Column:
    """Distinct spans of the findings (of some rules only), in order, as (kind, start, stop)."""
    chosen = F.col("findings") if rules is None else F.filter("findings", lambda f: f["rule"].isin(*[r.code for r in rules]))
    return F.array_distinct(F.transform(chosen, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["stop"].alias("stop"))))


def number_of(kind: str, rules: tuple[Rule, ...] | None = None) -> Column:
    return F.size(F.filter(spans(rules), lambda s: s["kind"] == kind)).cast("long")
