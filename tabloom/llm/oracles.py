"""SQL for the queries that SQL can express."""

OP1 = r"""
WITH rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS i, page_id, lower(regexp_extract(r, '^[^/?#]*')) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM parts, rules
         WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (i)
"""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT i, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT i, unnest(range(1, len(ws) - 1)) AS k, ws FROM w WHERE len(ws) > 2),
coded AS (SELECT i, k, ws[k] AS a, ws[k + 1] AS b, ws[k + 2] AS c FROM grams),
again AS (SELECT i, k FROM (SELECT i, k, count(*) OVER (PARTITION BY i, a, b, c) AS n FROM coded) WHERE n > 1),
covered AS (SELECT i, count(DISTINCT k + s) AS n FROM again, (VALUES (0), (1), (2)) v(s) GROUP BY i),
lines AS (SELECT i, doc_id, source, text, unnest(string_split(t, chr(10))) AS l FROM d),
worded AS (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(regexp_replace(lower(l), '\d', '0', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS plain FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT i, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY i),
common AS (SELECT source, plain, min(doc_id) AS keeper FROM worded WHERE plain <> '' GROUP BY source, plain HAVING count(DISTINCT text) > 20),
lost AS (SELECT i, sum(n) AS n FROM worded x JOIN common c ON x.plain = c.plain AND x.source IS NOT DISTINCT FROM c.source
         WHERE x.doc_id IS DISTINCT FROM c.keeper GROUP BY i),
f AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(lost.n, 0))::BIGINT AS words_left
      FROM d JOIN w USING (i) LEFT JOIN dup USING (i) LEFT JOIN covered USING (i) LEFT JOIN lost USING (i))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= n_words * (1.0 / 3)::DOUBLE AS kept FROM f
"""

# The closure runs over pairs found by shared shingles.
OP9 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT i, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT i, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
both_ AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.i < y.i GROUP BY x.i, y.i),
links AS (SELECT a, b FROM both_ JOIN n p ON p.i = a JOIN n q ON q.i = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT i AS a, i AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_ AS (SELECT r.a AS i, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.i = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (i) JOIN least_ USING (i)
"""

OP6 = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT i, label, e, len(e) AS d FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.i AS a, y.i AS b FROM ok x JOIN ok y ON x.label = y.label AND x.d = y.d AND x.i <> y.i WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
n AS (SELECT a AS i, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT i AS a, i AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT r.a AS i, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.i = r.b GROUP BY r.a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (i) LEFT JOIN n USING (i)
"""


def op11(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """All rounds as one chain of tables: a_r assigns, c_r moves the centroids."""
    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.i, m.c, list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} m) GROUP BY i)"""

    def move(r: int) -> str:
        return f"""s{r} AS (SELECT a.c, p.p, sum(v.q[p.p])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v USING (i), range(1, {width + 1}) p(p) GROUP BY a.c, p.p),
f{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS q FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f.q, m.q) AS q FROM c{r} m LEFT JOIN f{r} f USING (c))"""

    steps = ",\n".join(f"{assign(r)},\n{move(r)}" for r in range(rounds))
    return f"""
WITH x AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS MATERIALIZED (SELECT i, vec_id, list_transform(e, lambda y: floor(256 * y)::BIGINT) AS q FROM x WHERE len(e) = {width} AND len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {k})),
{steps},
{assign(rounds)},
g AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, cluster_inertia, (SELECT sum(d) FROM a{rounds})::BIGINT AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (i) JOIN g USING (c) JOIN c{rounds} m USING (c)
"""
