"""SQL forms of the queries, for comparison on the same tables."""

SQL: dict[str, str] = {}

SQL["op8_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS gram
      FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             (100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 60 * n_lines) AS soft FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed OR soft THEN 1 ELSE 0 END)::DOUBLE AS f FROM r GROUP BY host),
t AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS ff, count(*) / sum(n) AS hn FROM h),
p AS (SELECT m, CASE WHEN ff - m * m - m * (1 - m) * hn > 1e-12 THEN least(1e6, greatest(2.0, m * (1 - m) / (ff - m * m - m * (1 - m) * hn) - 1)) ELSE 1e6 END AS s FROM t),
v AS (SELECT host, (f + m * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND rate <= 0.6) AS kept, round(rate, 6) AS host_rate
FROM r JOIN v ON r.host IS NOT DISTINCT FROM v.host
"""

SQL["op2_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

SQL["op9_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS gram FROM w, unnest(range(1, len(words) - 11)) AS u(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM f WHERE first < doc_id) GROUP BY doc_id),
k AS (SELECT w.doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
         FROM k LEFT JOIN gone USING (doc_id) WHERE NOT coalesce(list_contains(js, i), false) GROUP BY k.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SQL["op5_decontaminate"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i:i+9], ' ') AS gram
        FROM bw, unnest(range(1, greatest(len(words) - 8, 2))) AS u(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM win),
dg AS (SELECT doc_id, i, size, array_to_string(words[i:i+size-1], ' ') AS gram FROM dw, sizes, unnest(range(1, len(words) - size + 2)) AS u(i)),
hit AS (SELECT DISTINCT doc_id, i, dg.size, item_id FROM dg JOIN win ON dg.gram = win.gram AND dg.size = win.size),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op6_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
edge AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
link AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id WHERE reach.root < link.b),
comp AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SQL["op1_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS gram FROM d, unnest(range(0, length(h) // 2 - 49)) AS u(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE first < doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, k, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, a AS b FROM span
        UNION ALL SELECT d.doc_id, coalesce(max(k), 0) + 1, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a::BIGINT + 1, 2 * (b - a)::BIGINT), '' ORDER BY k) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _secrets() -> str:
    """Matches by kind: the text is split at them, so that the lengths of pieces and matches add up to their places."""
    from .secret_scan import BASE_KINDS, RULES

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    cut = [
        f"SELECT doc_id, {n} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS gaps, "
        f"regexp_extract_all(t, {quoted(r.pattern)}) AS hits, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS keys FROM d"
        for n, r in enumerate(RULES)
    ]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(cut)}),
m AS (SELECT doc_id, rank, kind, least, hits[i] AS hit, keys[i] AS key,
             list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a
      FROM c, unnest(range(1, len(hits) + 1)) AS u(i)),
s AS (SELECT doc_id, rank, kind, a::BIGINT AS a, kind || ':' || a::BIGINT || ':' || (a + length(hit))::BIGINT AS said FROM m WHERE length(key) >= least),
g AS (SELECT doc_id, {counts}, string_agg(said, ',' ORDER BY a, rank) FILTER (kind IN ({base})) AS base, string_agg(said, ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


SQL["op4_secret_scan"] = _secrets()


def _lloyd(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Each round's centroids from those of the round before, in one statement."""

    def nearest(c: str) -> str:
        return f"""SELECT v.*, x.num AS cluster, x.d AS distance FROM v, LATERAL (
            SELECT num, (list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q))::BIGINT AS d FROM {c} c ORDER BY d, num LIMIT 1) x"""

    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({nearest(f"c{r}")}),
s{r} AS (SELECT cluster, i, sum(q[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, unnest(range(1, {dim + 1})) AS u(i) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS q FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT num, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = num)""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS num, q FROM v ORDER BY num LIMIT {k}),
{", ".join(steps)},
f AS ({nearest(f"c{rounds}")})
SELECT vec_id, cluster, distance, count(*) OVER (PARTITION BY f.q) AS copies, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.num = cluster
"""


SQL["op12_centroids"] = _lloyd()

SQL["op13_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
      FROM r a JOIN r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
