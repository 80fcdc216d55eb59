"""DuckDB SQL for the training-data queries that SQL can express."""

OP5_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

LEAKS = r"""
WITH masks(mask, places) AS (VALUES (0, [0, 1, 3, 6, 7]), (1, [0, 2, 3, 5, 7])),
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM DOCS),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS item FROM benchmark),
dp AS (SELECT rid, unnest(range(len(words) - 7)) AS pos, words FROM d WHERE len(words) >= 8),
bp AS (SELECT item_id, item, unnest(range(len(item) - 7)) AS pos FROM b WHERE len(item) >= 8),
ds AS (SELECT rid, pos, mask, hash(list_transform(places, lambda p: words[pos + p + 1])) AS seed FROM dp, masks),
bs AS (SELECT item_id, item, pos, mask, hash(list_transform(places, lambda p: item[pos + p + 1])) AS seed FROM bp, masks),
al AS (SELECT DISTINCT ds.rid, bs.item_id, bs.item, ds.pos - bs.pos AS shift FROM ds JOIN bs USING (mask, seed)),
ck AS (
  SELECT d.doc_id, al.item_id, greatest(-shift, 0) + shift AS start, least(len(item), 13) AS width,
         list_transform(range(greatest(-shift, 0), least(len(item), len(words) - shift)), lambda k: CASE WHEN item[k + 1] = words[k + shift + 1] THEN 1 ELSE 0 END) AS same
  FROM al JOIN d ON d.rid = al.rid),
ok AS (
  SELECT doc_id, item_id, start, len(same) AS overlap, list_sum(same)::BIGINT AS n_matches FROM ck
  WHERE len(same) >= width AND len(list_filter(range(len(same) - width + 1), lambda i: list_sum(same[i + 1 : i + width]) * 100 >= width * 80)) > 0)
SELECT doc_id, item_id, start, overlap, n_matches FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matches DESC, start, overlap) = 1
"""

URLS = r"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (
  SELECT p.host, l.bad FROM p JOIN (SELECT doc_id, CASE WHEN min(quality) = 0 THEN 1 ELSE 0 END AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l
  ON l.doc_id = try_cast(regexp_extract(p.path, '^/[^/]*/([0-9]{1,18})', 1) AS BIGINT)),
h AS (
  SELECT host, count(*) AS n, sum(bad) AS bad, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix
  FROM o GROUP BY host),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY suffix),
g AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS mean FROM s0),
s1 AS (SELECT s0.*, g.mean FROM s0, g),
ks AS (SELECT 1 / coalesce(least(greatest(sum(n * power(bad / n - mean, 2) / (mean * (1 - mean)) - 1) / nullif(sum(n - 1), 0), 0.001), 0.5), 0.5) - 1 AS k FROM s1),
s AS (SELECT suffix, (bad + k * mean) / (n + k) AS share FROM s1, ks),
d1 AS (SELECT d0.*, s.share AS mean FROM d0 JOIN s USING (suffix)),
kd AS (SELECT 1 / coalesce(least(greatest(sum(n * power(bad / n - mean, 2) / (mean * (1 - mean)) - 1) / nullif(sum(n - 1), 0), 0.001), 0.5), 0.5) - 1 AS k FROM d1),
d AS (SELECT domain, suffix, (bad + k * mean) / (n + k) AS share FROM d1, kd),
h1 AS (SELECT h.*, d.share AS mean FROM h JOIN d USING (domain, suffix)),
kh AS (SELECT 1 / coalesce(least(greatest(sum(n * power(bad / n - mean, 2) / (mean * (1 - mean)) - 1) / nullif(sum(n - 1), 0), 0.001), 0.5), 0.5) - 1 AS k FROM h1),
q AS (
  SELECT p.page_id, p.host, p.path, coalesce(h.n, 0) AS n_labelled, coalesce(h.n, 0) + k AS total,
         (coalesce(h.bad, 0) + k * coalesce(d.share, s.share, g.mean)) / (coalesce(h.n, 0) + k) AS share
  FROM p CROSS JOIN kh CROSS JOIN g LEFT JOIN h ON h.host = p.host
  LEFT JOIN d ON d.domain = array_to_string(list_slice(string_split(p.host, '.'), -2, -1), '.')
  LEFT JOIN s ON s.suffix = list_extract(string_split(p.host, '.'), -1)),
r(rule, rule_host, rule_path, said) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, n_labelled, total, share, (SELECT arg_max(struct_pack(rule, said), length(rule)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS fits
  FROM q)
SELECT page_id, host, path, fits.rule AS rule, coalesce(fits.said, CASE WHEN share - 1.645 * sqrt(share * (1 - share) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n_labelled, round(share - 1.645 * sqrt(share * (1 - share) / (total + 1)), 4) AS bad_at_least FROM m
"""


def _centroids(rounds: int = 3, k: int = 16) -> str:
    """Each round as common table expressions: the nearest centroid of every vector, then the floor of the mean by cluster."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    steps = [
        "v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::HUGEINT) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.rid, c.k, {square} AS d FROM v, c{r} c) GROUP BY rid)")
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT k, list(s ORDER BY i) AS x FROM (SELECT a.k, i, sum(v.x[i]) AS t, count(*)::HUGEINT AS n, t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END AS s FROM v JOIN a{r} a USING (rid), range(1, 65) g(i) GROUP BY a.k, i) GROUP BY k)"
            )
            steps.append(f"c{r + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))")
    last = rounds
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, a.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a{last} a USING (rid) JOIN c{last} c USING (k)"
    )


CENTROIDS = _centroids()

NGRAMS = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) END) AS own FROM d),
c AS (SELECT list_sort(own) AS own, min(rid) AS class, min(doc_id) AS doc_id FROM s WHERE len(own) > 0 GROUP BY ALL),
t AS (SELECT class, len(own) AS n, unnest(own) AS token FROM c),
l AS (
  SELECT a.class AS a, b.class AS b FROM t a JOIN t b ON a.token = b.token AND a.class <> b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(class, reached) AS (SELECT class, class FROM c UNION SELECT r.class, l.b FROM r JOIN l ON l.a = r.reached),
g AS (SELECT r.class, min(c.doc_id) AS component_id FROM r JOIN c ON c.class = r.reached GROUP BY r.class)
SELECT s.doc_id, len(s.own)::BIGINT AS n_shingles, CASE WHEN len(s.own) = 0 THEN s.doc_id ELSE g.component_id END AS component_id
FROM s LEFT JOIN c ON c.own = list_sort(s.own) LEFT JOIN g USING (class)
"""
