"""Each operator against its plain version, on a small dirty table and on the smallest given tables."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import bpe, graph, language, licences, minhash, mixing, pii, quality, suffixes, url_filter, vectors
from tabloom.llm.queries import REGISTRY, URL_RULES, vocabulary_path

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, row string, owner int, kept string, copies string, `c` double, `found` string"


def key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def say(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def dirty_rows():
    base, shared = say(120, 1), say(90, 2)
    edited = base.split()
    edited[60] = "other"
    texts = [None, "", "   \n\t ", "one two", "one two", base, base, base.upper(), " ".join(edited), shared, f"{say(40, 3)} {shared} {say(40, 4)}", f"{shared}\n{shared}",
             "a" * 5000, "a b " * 4000, say(20000, 5), "é ünï 🙂 " * 60, "mail me: joe.x@mail.example.com or +1 (555) 123-4567 at 10.1.2.3, card 4111 1111 1111 1111.",
             "<|endoftext|> Σ's \x1c x" * 30, "Released under the MIT License.\nall rights reserved", "no\u00a0break " * 80, "1.2.3.4.5.6.7.8 999.1.1.1 @@ a@b @c.d x@y.z@w.v"]
    texts += [f"{say(60, 100 + k)}\nThe same footer line of the host\n{say(30, 200 + k)}" for k in range(25)]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, 0) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None), (3, "one two three", "en", "s0", 0)]
    return [(*r, "x", "y", 1, "z", "w", 1.5, "v") for r in rows]


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(dirty_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_urls(spark):
    urls = [None, "", "no url", "http://Example.NET", "http://example.net/", "https://a.b.EXAMPLE.com/de/x?y#z", "https://x.org/fr", "https://x.org/fr/", "http://example.network/",
            "ftp://user@h.net:80/a//b/", "://net/", "http://net/x://y", "http://a.example.net/en/1#/", "http://" + "a." * 60 + "net/" + "b/" * 500, "http://é.org/fr/é"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(None, "http://a.net/", "h", "r"), (4, urls[4], "h", "r")], "page_id long, url string, host string, rule string")
    rules = [*URL_RULES, ("block", "b.example.com", "/d"), ("allow", "h.net:80", ""), ("block", "org", "/fr/é")]
    got = rows_of(url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)), "page_id", "host", "path", "rule", "verdict")
    want = sorted(((r.page_id, *brute.url_verdict(r.url, rules)) for r in pages.collect()), key=key)
    assert got == want
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark, rules).limit(0)).where("verdict = 'allow' and rule is null").count() == pages.count()


def quality_rows(docs, **limits):
    return rows_of(quality.judge_documents(docs, **limits), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", "base_failed", "kept")


def test_quality(dirty, none, given):
    for docs, limit in ((dirty, 5), (given, 20), (given, 1)):
        want = sorted(brute.quality([(r.doc_id, r.text, r.source) for r in docs.collect()], limit), key=key)
        assert quality_rows(docs, max_docs=limit) == want
    assert quality_rows(none) == []
    cleaned = quality.clean_documents(dirty, max_docs=5)
    assert cleaned.columns == dirty.columns
    footers = cleaned.where("text like '%same footer%' and source is not null").groupBy("source").count().collect()
    assert {r["count"] for r in footers} == {1}
    assert cleaned.count() == sum(r[-1] for r in quality_rows(dirty, max_docs=5))


def test_personal_data(dirty, none, given):
    for docs in (dirty, given):
        found = pii.find_personal_data(docs).select("doc_id", "hash", pii.written(F.col("plain")).alias("plain"), pii.written(pii.all_spans()).alias("spans"))
        keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").collect()
        assert rows_of(found, "doc_id", "hash", "plain") == sorted(((r.doc_id, r.hash, brute.personal(r.text)) for r in keyed), key=key)
        for r in found.collect():
            assert set(r.plain.split(",")) <= set(r.spans.split(",")) or not r.plain
    assert pii.find_personal_data(none).count() == 0
    masked = {r.doc_id: r.text for r in pii.redact(dirty).where("doc_id = 16").collect()}
    assert masked[16] == "mail me: <email> or <phone> at <ip>, card <card>."


def test_personal_data_discovers_by_context(spark):
    rows = [(k, f"{say(5, k)} please dial hotline {'+1 555 010 ' + str(1000 + k) if k < 30 else 'X' + str(77000 + k) + 'Q'} today {say(5, 500 + k)}") for k in range(34)]
    rows += [(100 + k, f"{say(6, 900 + k)} chapter {1000000 + k} {say(6, 700 + k)}") for k in range(30)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("found").alias("n"), F.get("found", F.lit(0))["kind"].alias("kind")).collect()
    assert {(r.doc_id, r.n, r.kind) for r in found if r.n > 0} == {(k, 1, "phone") for k in range(30, 34)}


def plain_trust(edges, trust, least_share):
    """Scores by turns until they stand still, from (pattern, instance, kind or None)."""
    held = defaultdict(list)
    for p, i, k in edges:
        held[p].append((i, k))
    of = {}
    for p, rows in held.items():
        n, kind = max((sum(k == x for _, k in rows), x) for x in pii.KINDS)
        if n >= max(pii.LEAST_SEEDS, trust * sum(k is not None for _, k in rows), least_share * len(rows)):
            of[p] = (kind, n, [i for i, k in rows if k is None])
    scores = {p: n / (len(held[p]) + 1) for p, (_, n, _) in of.items()}
    for _ in range(2000):
        best = defaultdict(float)
        for p, (kind, _, unseen) in of.items():
            for i in unseen:
                best[i, kind] = max(best[i, kind], scores[p])
        scores = {p: (n + sum(best[i, kind] for i in unseen)) / (len(held[p]) + 1) for p, (kind, n, unseen) in of.items()}
    return {(p, of[p][0]) for p, x in scores.items() if x >= trust}


def test_pattern_scores_reach_their_fixed_point(spark):
    r = random.Random(8)
    edges = {(p, 1000 * p + i, "phone" if i < 30 else None) for p, unseen in ((1, 40), (2, 89), (3, 95)) for i in range(30 + unseen)}
    edges |= {(4, 5000 + i, "phone" if i % 2 else "card") for i in range(40)} | {(5, 6000 + i, "ip") for i in range(4)}
    edges |= {(r.randint(10, 40), i, "email" if i % 3 else None) for i in range(400)} | {(r.randint(10, 40), 3 * i, None) for i in range(300)}
    frame = spark.createDataFrame(sorted(edges, key=key), "pattern long, instance long, kind string")
    got = {tuple(t) for t in pii.trusted_patterns(frame).collect()}
    assert got == plain_trust(edges, pii.TRUST, pii.LEAST_SHARE) and {(1, "phone"), (2, "phone")} <= got and not {p for p, _ in got} & {3, 4, 5}
    assert pii.trusted_patterns(frame.limit(0)).count() == 0


def test_personal_data_with_more_unseen_than_seeds(spark):
    rows = [(k, f"{say(5, k)} please dial hotline {'+1 555 010 ' + str(1000 + k) if k < 30 else 'X' + str(77000 + k) + 'Q'} today {say(5, 500 + k)}") for k in range(70)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("found") == 1)
    assert rows_of(found, "doc_id") == sorted(((k,) for k in range(30, 70)), key=key)
    assert pii.contexts("z" * 90 + " 123456", 91, 97) == pii.contexts("y" * 95 + " 123456", 96, 102) == []


def test_personal_data_discovers_groups_of_digits(spark):
    texts = ["4111 1111 1111 1112", "030 123 4567", "(555) 123-4567", "X" * 60 + "7" * 60]
    rows = [(k, f"{say(5, k)} please dial hotline +1 555 010 {1000 + k} today {say(5, 500 + k)}") for k in range(60)]
    rows += [(100 + k, f"{say(5, 100 + k)} please dial hotline {t} today {say(5, 600 + k)}") for k, t in enumerate(texts)]
    masked = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").collect()}
    assert all(masked[100 + k] == f"{say(5, 100 + k)} please dial hotline <phone> today {say(5, 600 + k)}" for k in range(len(texts)))
    assert list(pii.candidates("1" * 300_000 + " " + "(" * 300_000, [])) == [(0, 300_000)]


def test_email_time_is_linear():
    assert pii.plain_spans("a" * 300_000 + " " + "1" * 300_000 + "@" * 1000) == []


def test_bpe(dirty, none, given):
    library = Tokenizer.from_file(vocabulary_path())
    for docs in (dirty, given):
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes().hex(), library.decode(ids, skip_special_tokens=False)))
        coded = bpe.encode_decode(docs, vocabulary_path())
        assert rows_of(coded.select("doc_id", "n_tokens", F.lower(F.hex("ids")).alias("ids"), "decoded"), "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=key)
    again = bpe.decode(bpe.encode_decode(given, vocabulary_path()), vocabulary_path())
    assert rows_of(again, "doc_id", "decoded") == rows_of(bpe.encode_decode(given, vocabulary_path()), "doc_id", "decoded")
    assert bpe.encode_decode(none, vocabulary_path()).count() == 0


def test_merge_order_of_long_pieces():
    library, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.Vocabulary.read(vocabulary_path())
    r = random.Random(4)
    for n in (1, 2, 3, 17, 400, 3000):
        text = "".join(r.choice("aaabcdethin") for _ in range(n))
        assert np.frombuffer(own.encode_decode(text)[1], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_mixing(dirty, none, given):
    for docs in (dirty, given):
        mixed = mixing.mix(docs)
        got = mixed.collect()
        assert sorted((r.doc_id or -1, r.copies) for r in got) == sorted((r.doc_id or -1, r.copies) for r in mixing.mix(docs.repartition(5)).collect())
        sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.size * r.copies
            largest[r.source] = max(largest[r.source], r.size)
            assert 0 <= r.copies <= 2
        assert sum(sizes.values()) == sum(len(brute.WORD.findall(r.text or "")) for r in docs.collect())
        want = brute.targets(sizes)
        for r in got:
            assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[r.source]
        for source, words in taken.items():
            assert abs(words - want[source]) <= 3 * largest[source]  # three rows of the dirty table are equal
    assert mixing.mix(none).count() == 0
    assert mixing.take(dirty).columns == dirty.columns


def test_pareto_sampling_meets_inclusion_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")), F.col("id").cast("string")).alias("text"),
                                    F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= 8


def test_vectors(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal((40, 16))
    rows = [(k, base[k].tolist(), k % 2) for k in range(40)]
    rows += [(100 + k, (base[0] + 0.02 * r.standard_normal(16)).tolist(), 0) for k in range(30)] + [(200 + k, (base[2] * 3).tolist(), 0) for k in range(4)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] + [1.0] * 15, 0), (304, [None] + [1.0] * 15, 0), (305, base[3].tolist(), None), (306, base[3].tolist()[:8], 1),
             (307, base[3].tolist()[:8], 1), (None, base[5].tolist(), 1), (309, [float("inf")] * 16, 0), rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).repartition(3)
    assert rows_of(vectors.near_vectors(table), "vec_id", "n_links", "component_id", "kept") == sorted(((i, n, c, i == c) for i, n, c, _ in brute.vectors(rows)), key=key)
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_long_lists_are_cut_and_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(8)
    base = r.standard_normal(32)
    rows = [(k, (base + 0.05 * r.standard_normal(32)).tolist(), 1) for k in range(150)] + [(1000 + k, r.standard_normal(32).tolist(), 1) for k in range(100)]
    got = rows_of(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id", "n_links", "component_id")
    want = sorted(((i, n, c) for i, n, c, _ in brute.vectors(rows)), key=key)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found >= 0.99 * there and all(g[1] <= w[1] for g, w in zip(got, want)) and [g[::2] for g in got] == [w[::2] for w in want]


def test_postings_are_narrow_and_vectors_keep_their_type(spark):
    r = np.random.default_rng(9)
    rows = [(k, [float(np.float32(x)) for x in r.standard_normal(12)], k % 3) for k in range(60)]
    rows += [(100 + k, [float(np.float32(x)) for x in np.array(rows[k % 4][1]) * (1 + 0.01 * r.standard_normal(12))], rows[k % 4][2]) for k in range(40)]
    want = sorted(((i, n, c) for i, n, c, _ in brute.vectors(rows)), key=key)
    for kind in ("float", "double"):
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        assert rows_of(vectors.near_vectors(table), "vec_id", "n_links", "component_id") == want
        classes = table.select(F.col("vec_id").alias("node"), F.lit(1).alias("n"), F.col("label").cast("long"), F.col("embedding").alias("v"))
        index = dict(vectors.described(classes, {}).dtypes)
        assert index["v"] == f"array<{kind}>" and index["lists"] == "array<struct<list:bigint,last:smallint>>"


def test_pieces_are_compared_alike_however_batches_cut_them():
    r = np.random.default_rng(10)
    v = np.repeat(r.standard_normal((5, 8)), 12, axis=0) + 0.02 * r.standard_normal((60, 8))
    near = np.sort(np.argsort(r.random((60, vectors.PIVOTS)), axis=1)[:, :vectors.NEAREST], axis=1)
    near[:, :3] = [0, 1, 2]
    column = lambda x, n: pa.ListArray.from_arrays(np.arange(61, dtype=np.int32) * n, pa.array(x.ravel()))
    rows = pa.table({"list": np.repeat([1, 2, 3], [1, 29, 30]), "i": np.zeros(60, np.int32), "j": np.repeat(np.array([0, 1], np.int32), [30, 30]), "block": np.arange(60, dtype=np.int32) % 2,
                     "node": np.arange(60), "n": np.ones(60, np.int64), "label": np.zeros(60, np.int64), "last": np.full(60, 2, np.int16), "near": column(near.astype(np.int16), 7), "v": column(v, 8)})
    found = [sorted(x for b in vectors.piece_links(iter(rows.to_batches(max_chunksize=size))) for x in zip(*b.to_pydict().values())) for size in (1, 7, 60)]
    assert found[0] == found[1] == found[2]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    meet = (u @ u.T >= vectors.COSINE) & (rows["list"].to_numpy()[:, None] == rows["list"].to_numpy()) & ~np.eye(60, dtype=bool)
    meet[30:] &= np.arange(30, 60)[:, None] % 2 != np.arange(60) % 2
    assert {node: links for node, _, links in found[0]} == {k: meet[k].sum() for k in range(60) if meet[k].any()}


def test_of_equally_near_pivots_the_first_count():
    points = np.zeros((vectors.PIVOTS, 4))
    points[[5, 9], 0] = 1.0
    assert vectors.nearest(np.eye(4)[:2], points).tolist() == [[0, 1, 2, 3, 4, 5, 9], [0, 1, 2, 3, 4, 5, 6]]


def test_suffixes(dirty, none, given):
    cut = lambda docs: rows_of(suffixes.remove_repeats(docs).select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]).alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")), "doc_id", "n_bytes", "n", "s", "h")
    for docs in (dirty, given):
        assert cut(docs) == sorted(brute.repeats([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert cut(none) == []


def test_suffixes_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 4)
    passage = say(80, 1)
    rows = [(k, f"{say(20, 10 + k)} {passage[:410 + 3 * (k % 9)]} {say(20, 90 + k)}") for k in range(30)] + [(99, passage[:399])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(suffixes.remove_repeats(docs).select("doc_id", F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]).alias("n")), "doc_id", "n")
    assert got == sorted(((i, n) for i, _, n, _, _ in brute.repeats(rows)), key=key)


def test_suffix_query_gives_what_stays(spark, tmp_path):
    passage, x, y = say(90, 1), say(30, 2), say(30, 3)
    short = passage[:399]
    rows = [(1, f"{x}\u00e9{passage}\u00e9{y}"), (2, f"{y}\u0129{passage}#{x}"), (3, f"{x}<{short}>"), (4, f"({short})"), (5, "K" + y * 3), (6, "K" + y * 3), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in REGISTRY["op8_suffix_dedup"][0](spark, str(tmp_path)).collect()}
    want = {k: (n, removed, spans, digest) for k, n, removed, spans, digest in brute.repeats(rows)}
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == want
    assert all(r.n_kept == r.n_bytes - r.n_removed for r in got.values())
    # the passage starts within a character of 1 and 2; below 400 bytes it stays, whole copies lose all
    stays = {1: f"{x}\ufffd\u00e9{y}", 2: f"{y}\ufffd#{x}", 3: rows[2][1], 4: rows[3][1], 5: "", 6: "", 7: ""}
    assert {k: r.text for k, r in got.items()} == stays


def test_suffix_sort_is_in_order():
    r = np.random.default_rng(2)
    text = r.integers(97, 99, 4000).astype(np.uint8)
    start, group = np.arange(0, 3900), np.repeat(np.arange(13), 300)
    order, same = suffixes.sort_suffixes(text, start, group, 31)
    data = text.tobytes()
    values = [(int(group[k]), data[start[k]:start[k] + 31]) for k in order]
    assert values == sorted(values)
    assert same.tolist() == [False] + [a == b for a, b in zip(values, values[1:])]


def test_minhash(dirty, none, given):
    for docs in (dirty, given):
        want = sorted(brute.near([(r.doc_id, r.text) for r in docs.collect()]), key=key)
        got = rows_of(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
        assert [g[:3] for g in got if g[0] is not None] == [w[:3] for w in want if w[0] is not None]
        assert all(g[3] == (g[0] == g[2]) for g in got if g[0] is not None)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.deduplicate(dirty)
    assert kept.columns == dirty.columns and kept.where(F.col("text").isin(dirty_rows()[5][1], dirty_rows()[7][1])).count() == 1


def test_bayes_limits_keep_pairs_at_the_threshold():
    limits = minhash.least_matches()
    r = np.random.default_rng(1)
    hits = r.random((20_000, minhash.HASHES)) < 0.75
    alive = np.ones(20_000, bool)
    for k, limit in enumerate(limits):
        alive &= hits[:, :(k + 1) * minhash.BATCH].sum(axis=1) >= limit
    assert alive.mean() > 0.999 and limits == sorted(limits) and limits[-1] > 60


def test_language(spark, given):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = language.identify(pages, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    truth = pages.select("page_id", F.regexp_extract("url", "://[^/]*/([a-z]+)", 1).alias("truth"))
    assert found.join(truth, "page_id").where("language = truth").count() >= 0.97 * pages.count()
    odd = spark.createDataFrame([(1, None, None, "q"), (None, "http://x.example.com/", "", "q"), (2, "http://m.theraa.example.com/fr/", "<html lang='fr'></html>", "q"), (2, "x", "<p>" + "y" * 100_000, "q")],
                                "page_id long, url string, html string, language string")
    both = language.identify(pages.select("page_id", "url", "html").unionByName(odd.drop("language")), given)
    assert both.count() == pages.count() + 4 and both.where("language is null").count() == 0
    assert both.where("page_id = 2 and declared = 'fr' and text_language is null").first()["language"] == "fr"
    assert language.identify(odd, given.limit(0)).where("language is null").count() == 4
    assert language.identify(odd.limit(0), given).count() == 0


def test_licences(dirty, none, spark):
    found = {r.doc_id: (r.families, r.n_paragraphs) for r in licences.document_licences(dirty.where("doc_id is not null")).collect()}
    assert found[18] == (["mit", "proprietary"], 2) and sum(bool(f) for f, _ in found.values()) == 1
    assert licences.document_licences(dirty).count() == dirty.count() and licences.document_licences(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = F.expr(r"array_join(filter(array(if(text like '%Apache License, Version%', 'apache-2.0', ''), if(text like '%Licensed under CC BY-NC%', 'cc-by-nc', ''), if(text like '%GNU General Public License, version 3%', 'gpl', ''), if(text like '%under the MIT License%', 'mit', ''), if(text like '%All rights reserved.%', 'proprietary', '')), x -> x <> ''), ',')")
    held_out = licences.document_licences(docs).join(docs.select("doc_id", marks.alias("truth")), "doc_id")
    assert held_out.where("array_join(families, ',') <> truth").count() == 0


WRAPPED = {
    "gpl": "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
    "apache-2.0": "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    "lgpl": "This work is licensed under the GNU Lesser\nGeneral Public License, version 3",
    "apache-2.0,mit": "under the MIT License or the Apache License, Version 2.0",
    "apache-2.0,mit ": "Licensed under the Apache License, Version 2.0\nor the MIT License, at your option",
    "cc-by-nc": "Licensed under CC\nBY-NC 4.0",
    "": "the general public was invited\nunder the terms of the members",
}


def test_licences_across_lines_and_dual(spark):
    docs = spark.createDataFrame([(k, f"{say(30, k)}\n\n{t}\n\n{say(30, 50 + k)}") for k, t in enumerate(WRAPPED.values())] + [(99, "Released under the MIT License.\n" * 3)], "doc_id long, text string")
    found = {r.doc_id: (",".join(r.families), r.n_paragraphs) for r in licences.document_licences(docs).collect()}
    assert [found[k] for k in range(len(WRAPPED))] == [(w.strip(), int(w != "")) for w in WRAPPED]
    assert found[99] == ("mit", 3)


def test_licence_gate_passes_what_can_be_confirmed(spark):
    r, rows = random.Random(5), []
    for t in licences.templates():
        rows += [" | ".join(r.sample(t["grams"], t["need"])) for _ in range(40)]
    rows += ["Use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
             "hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert docs.where(licences.holds(F.col("text"), licences.covers()) & licences.may_confirm(F.col("text"))).count() == len(rows)
    found = licences.document_licences(docs.where(f"doc_id >= {len(rows) - 2}")).orderBy("doc_id").collect()
    assert [f.families for f in found] == [["bsd"], ["mit"]]


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 16, "STEP": 5}, {"BLOCK": 16, "STEP": 5, "HELD": 700}, {"HELD": 1}])
def test_groups_about_the_threshold_keep_every_joining_link(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(minhash, name, value)
    r, base, rows = random.Random(12), say(150, 77).split(), []
    for k in range(70):  # copies of one text with so many edits that many pairs lie just above or below the limit
        words = list(base)
        for at in r.sample(range(150), r.randrange(1, 9)):
            words[at] = f"edit{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.near(rows)
    assert 2 <= len({w[2] for w in want}) <= 65
    assert rows_of(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=key)


@pytest.mark.parametrize("forest", [400_000, 3])
def test_components(spark, monkeypatch, forest):
    monkeypatch.setattr(graph, "FOREST", forest)
    r = random.Random(9)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(300)] + [(5000, 5001 + k) for k in range(300)] + [(7, 7), (-3, 5000), (-3, 5000)]
    r.shuffle(links)
    ids = sorted({x for a, b in links if a != b for x in (a, b)})
    place = {x: k for k, x in enumerate(ids)}
    want = dict(zip(ids, brute.closure(ids, [(place[a], place[b]) for a, b in links if a != b])))
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = graph.components(df).collect()
    assert {x.node: x.root for x in got} == want and len(got) == len(want)
    assert graph.components(df.limit(0)).count() == 0


def test_queries_give_the_contract_columns(spark):
    want = {"op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op5_mixing": "doc_id size source_size target taken",
            "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op9_minhash": "doc_id n_shingles component_id kept"}
    for name, columns in want.items():
        assert REGISTRY[name][0](spark, SF).columns[:len(columns.split())] == columns.split()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    library = Tokenizer.from_file(vocabulary_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
    start, clean, unique, masked, mixed, coded = steps
    assert all(s.columns == docs.columns for s in steps[:-1])
    judged = brute.quality([(r.doc_id, r.text, r.source) for r in start.collect()])
    assert sorted(r.doc_id for r in clean.collect()) == sorted(j[0] for j in judged if j[-1])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, _, _, kept in brute.near([(r.doc_id, r.text) for r in clean.collect()]) if kept)
    assert masked.count() == unique.count() and not any(brute.personal(r.text) for r in masked.collect())
    sizes = defaultdict(int)
    for r in masked.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text))
    want, taken = brute.targets(sizes), defaultdict(int)
    for r in mixed.collect():
        taken[r.source] += len(brute.WORD.findall(r.text))
    assert all(abs(taken[s] - want[s]) <= 0.15 * want[s] + 2000 for s in want)
    codes = sorted((r.doc_id, hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in coded.collect()) == codes
    assert corpus_pipeline.run(spark, SF).count() == coded.count()
