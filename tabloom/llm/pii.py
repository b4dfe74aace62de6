"""Personal data by patterns, widened by bootstrapped contextual extraction.

Entities that plain patterns prove are seeds. The words beside a seed make lexical patterns; Spark counts how patterns and
instances (seeds and identifier-like strings that no plain pattern takes) occur together, and scores both in turns: a pattern
is trusted by the share of its instances that are trusted, an instance by the patterns it appears in. The rounds end when the
trusted patterns are those of the fixed point. A pattern takes part if its kind has ``LEAST_SEEDS`` seeds, ``TRUST`` of all its
seeds (kinds in conflict have none) and ``LEAST_SHARE`` of all its instances. Strings in the context of patterns that reach
``TRUST`` are discovered identifiers and become spans of the pattern's kind. Neighbour words that reach beyond 80 characters
before or 40 after a place are no context.

Defined cases: a null or empty text has no spans; repeated rows have equal results and count once as evidence; a table without
seeds has no patterns; an empty table gives an empty result; null ids are kept; other columns are not read. Candidates that
overlap a plain span are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import split_join
from .rows import cut_lineage, map_rows, sql_type, text_key

KINDS = ("email", "ip", "card", "phone")
TRUST = 0.8
LEAST_SHARE = 0.25  # of a pattern's distinct instances that must be seeds of its kind
SETTLED = 1e-9
LEAST_SEEDS = 5  # distinct seed instances that a pattern needs
SMOOTHING = 1.0

# The plain patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# strings that look like identifiers: with a digit or an @, six letters or more
CANDIDATE = re.compile(r"[^\s\"'<>()\[\]{},;]{6,}")
# groups of digits with blanks, brackets or dashes between them, as cards and phones are written
GROUPS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]++(?:[ ().-]{1,3}[0-9]++)+")
LEAST_DIGITS = 7
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @ outwards: the name before it cannot hold another @, so its start is the start of the run before."""
    start, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > start and text[begin - 1] in LOCAL_LETTERS:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            start = domain.end()
        else:
            start = at + 1
        at = text.find("@", start)


def plain_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    text = text or ""
    found = [(a, b, 0) for a, b in emails(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda f: (f[0], f[2]))]


def code(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) - (1 << 63)


def contexts(text: str, start: int, end: int) -> list[int]:
    """Patterns around a place: the word before, the two words before, the words on both sides, and the word after, in lower case
    without digits. Before the place, tokens without letters are passed over."""
    low, high = max(0, start - 80), end + 40
    left, right = text[low:start].split(), text[end:high].split()
    if low and left and not text[low - 1].isspace() and not text[low].isspace():
        del left[0]  # cut by the reach
    if len(right) == 1 and high < len(text) and not text[high - 1].isspace() and not text[high].isspace():
        del right[0]
    before = [w for w in (re.sub(r"[\d\W_]+", "", w.lower()) for w in left) if w][-2:]
    after = [re.sub(r"[\d\W_]+", "", w.lower()) for w in right[:1]]
    out = []
    if before:
        out.append(code("1 " + before[-1]))
        if len(before) == 2:
            out.append(code("2 " + " ".join(before)))
        if after and after[0]:
            out.append(code(f"3 {before[-1]} _ {after[0]}"))
    if after and after[0]:
        out.append(code("4 " + after[0]))
    return out


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places of identifier-like strings in order, clear of the places taken: groups of digits, then runs without a gap."""
    def clear(found: Iterator[tuple[int, int]], of: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        at = 0
        for a, b in found:
            while at < len(of) and of[at][1] <= a:
                at += 1
            if at == len(of) or of[at][0] >= b:
                yield a, b

    groups = list(clear(((m.start(), m.end()) for m in GROUPS.finditer(text) if len(NOT_DIGIT.sub("", m[0])) >= LEAST_DIGITS), taken))
    runs = ((m.start(), m.start() + len(m[0].rstrip(".:!?"))) for m in CANDIDATE.finditer(text))
    runs = ((a, b) for a, b in runs if b - a >= 6 and any(c.isdigit() or c == "@" for c in text[a:b]))
    yield from sorted([*groups, *clear(runs, sorted([*taken, *groups]))])


def evidence(text: str | None) -> tuple[list[dict], list[dict]]:
    """Plain spans, and mentions: each seed and candidate with its place, instance and patterns; kind is null for candidates."""
    text = text or ""
    plain = plain_spans(text)
    mentions = [{"start": a, "stop": b, "kind": k, "instance": code(text[a:b]), "patterns": contexts(text, a, b)} for a, b, k in plain]
    for a, b in candidates(text, sorted((a, b) for a, b, _ in plain)) if any(c in text for c in "0123456789@") else ():
        if patterns := contexts(text, a, b):
            mentions.append({"start": a, "stop": b, "kind": None, "instance": code(text[a:b]), "patterns": patterns})
    return [{"start": a, "stop": b, "kind": k} for a, b, k in plain], mentions


def trusted_patterns(edges: DataFrame, trust: float = TRUST, least_share: float = LEAST_SHARE) -> DataFrame:
    """(pattern, kind) of trust, from distinct edges (pattern, instance, kind of a seed or null). Sums over edges only: a
    frequent word's pattern is one partial sum per task.

    Scores start from the seeds alone and only rise. A pattern's score moves by at most q times the largest change of a round
    before, q being the largest share of unseen instances, so no score can still rise by more than q / (1 - q) times the last
    change: the rounds end when no pattern below trust can reach it any more, as one aggregate a round tells."""
    counts = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.count("kind").alias("all_seeds"), F.array_max(F.array(*[
        F.struct(F.count_if(F.col("kind") == k).alias("seeds"), F.lit(k).alias("kind")) for k in KINDS])).alias("best"))
    counts = counts.select("pattern", "instances", "all_seeds", "best.seeds", "best.kind")
    most_seeds = F.greatest(F.lit(LEAST_SEEDS), trust * F.col("all_seeds"), least_share * F.col("instances"))
    ranked = counts.where(F.col("seeds") >= most_seeds).withColumn("score", F.col("seeds") / (F.col("instances") + SMOOTHING))
    ranked = cut_lineage(ranked.drop("all_seeds"))
    unseen = cut_lineage(split_join(edges.where("kind is null").select("pattern", "instance"), ranked.select("pattern", "kind"), "pattern"))
    q = ranked.agg(F.coalesce(F.max((F.col("instances") - F.col("seeds")) / (F.col("instances") + SMOOTHING)), F.lit(0.0))).first()[0]
    while True:
        # an unseen instance is as good as its best pattern; seeds stay certain
        grown = split_join(unseen, ranked.select("pattern", "score"), "pattern").groupBy("instance", "kind").agg(F.max("score").alias("score"))
        sums = split_join(unseen, grown, ["instance", "kind"]).groupBy("pattern").agg(F.sum("score").alias("sum"))
        score = (F.col("seeds") + F.coalesce("sum", F.lit(0.0))) / (F.col("instances") + SMOOTHING)
        ranked = cut_lineage(split_join(ranked.withColumnRenamed("score", "was"), sums, "pattern", "left").select(
            "pattern", "instances", "seeds", "kind", "was", score.alias("score")))
        state = ranked.agg(F.max(F.abs(F.col("score") - F.col("was"))).alias("change"), F.max(F.when(F.col("score") < trust, F.col("score"))).alias("below")).first()
        ranked = ranked.drop("was")
        if state["below"] is None or state["change"] < SETTLED or state["below"] + state["change"] * q / (1 - q) < trust:
            return ranked.where(F.col("score") >= trust).select("pattern", "kind")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust: float = TRUST) -> DataFrame:
    """id, hash (of the text), plain and found: arrays of (start, stop, kind) in order; ``found`` holds what was discovered."""
    span = "struct<start:int,stop:int,kind:string>"
    seen = cut_lineage(map_rows(
        docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)),
        f"id {sql_type(docs, id_col)}, hash long, plain array<{span}>, mentions array<struct<start:int,stop:int,kind:string,instance:long,patterns:array<long>>>",
        lambda key, h, text: (key, h, *evidence(text))))
    mentions = seen.select(text_key("id").alias("owner"), "hash", F.inline("mentions"))
    edges = mentions.select("instance", "kind", F.explode("patterns").alias("pattern")).distinct()
    patterns = trusted_patterns(edges, trust)
    open_ = mentions.where("kind is null").select("owner", "hash", "start", "stop", F.explode("patterns").alias("pattern"))
    found = split_join(open_, patterns, "pattern").groupBy("owner", "hash", "start", "stop").agg(F.min("kind").alias("kind"))
    found = found.groupBy("owner", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias("found"))
    out = split_join(seen.select("id", text_key("id").alias("owner"), "hash", "plain"), found, ["owner", "hash"], "left")
    return out.select(F.col("id").alias(id_col), "hash", "plain", F.coalesce("found", F.array().cast(f"array<{span}>")).alias("found"))


def all_spans() -> Column:
    """Plain and discovered spans by start, then kind as listed."""
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    return F.array_sort(F.transform(F.concat("plain", "found"), order))


def number_of(kind: str) -> Column:
    return F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; other columns stay. Overlapping spans are one,
    named by the first."""
    found = find_personal_data(docs, id_col, text_col, **limits).select(text_key(id_col).alias("owner"), "hash", all_spans().alias("spans"))
    found = found.where(F.size("spans") > 0).dropDuplicates(["owner", "hash"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(id_col).alias("owner"), F.xxhash64(text_col).alias("hash"))
    text = F.col("row")[text_col]
    # from the left: (end of what is done, text so far)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(done: Column, s: Column) -> Column:
        add = F.concat(done["text"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("<"), s["kind"], F.lit(">"))
        over = s["start"] < done["at"]
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), F.when(over, done["text"]).otherwise(add).alias("text"))

    masked = F.aggregate("spans", begin, step, lambda d: F.concat(d["text"], F.substring(text, d["at"] + 1, F.length(text))))
    joined = split_join(packed, found, ["owner", "hash"], "left")
    return joined.select(F.col("row").withField(f"`{text_col}`", F.when(F.col("spans").isNotNull(), masked).otherwise(text)).alias("row")).select("row.*")
