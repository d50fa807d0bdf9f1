"""DuckDB SQL for the operators whose results SQL can express, on whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _reach(nodes: str, links: str) -> str:
    """CTEs ending in comp (id, component): the least node that links (a, b) reach."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach AS (SELECT id, id AS other FROM {nodes} UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)"""


EMBEDDING_NEARDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM u x, u y WHERE x.id < y.id AND list_dot_product(x.e, y.e) >= 0.9),
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) AS q GROUP BY 1),
{_reach('v', 'links')}
SELECT comp.id AS vec_id, coalesce(n.n, 0) AS n_links, component AS component_id, comp.id = component AS kept
FROM comp LEFT JOIN n USING (id)"""

_WORDS = "regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[k:k + 3], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM w WHERE len(w) > 0) AS q GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_sets AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_sets JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
v AS (SELECT doc_id AS id FROM documents),
{_reach('v', 'links')}
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id FROM comp LEFT JOIN n ON n.doc_id = id"""

_CLEAN = f"regexp_extract_all(coalesce(translate(text, '{UPPER}', '{LOWER}'), ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_CLEAN} AS w FROM documents),
b AS (SELECT item_id, {_CLEAN} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0) AS q),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) AS l WHERE len(w) >= n) AS q),
hits AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM hits) AS h) AS q GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS i FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) AS q GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

REPEATED_PASSAGES = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS s FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50) AS q),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN low USING (s) WHERE doc_id > low),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _round(n: int) -> str:
    """CTEs: assignment n (key, d, c) of the kept vectors v to centroids c<n>, and the centroids after it."""
    return f"""m{n} AS (SELECT key, min(d * 16 + c) AS m FROM (
  SELECT v.key, p.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - p.e[i]) * (v.e[i] - p.e[i])))::BIGINT AS d
  FROM v, c{n} p) AS q GROUP BY 1),
a{n} AS (SELECT key, m // 16 AS d, m % 16 AS c FROM m{n}),
s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
  SELECT c, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{n} JOIN v USING (key)) AS q GROUP BY 1, 2),
c{n + 1} AS (SELECT p.c, coalesce(q.e, p.e) AS e FROM c{n} p LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{n} GROUP BY 1) AS q ON q.c = p.c)"""


CENTROID_CLUSTERS = f"""
WITH k AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT row_number() OVER () AS key, vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS e FROM k
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (
  SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT 16) AS q),
{_round(0)},
{_round(1)},
{_round(2)},
{_round(3).split("," + chr(10) + "s3")[0]},
t AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a3 GROUP BY 1)
SELECT vec_id, a3.c::INTEGER AS cluster, a3.d AS distance, cluster_inertia,
  (SELECT sum(cluster_inertia)::BIGINT FROM t) AS inertia,
  sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN v USING (key) JOIN t ON t.c = a3.c JOIN c3 ON c3.c = a3.c"""

FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format(text='text')} AS w FROM documents),
low AS (SELECT t, min(doc_id) AS low FROM d GROUP BY 1),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t), regexp_matches(d.t, '[#$%&*|]'),
    coalesce(d.doc_id > low.low, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN low ON low.t = d.t LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, len(list_filter(fails, lambda x: x)) AS n_fails, count(*) AS n, count(*) FILTER (good) AS n_good,
  count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT o, step, [position(z IN 'ABCDE') FOR z IN string_split(o[:step - 1], '') IF z <> ''] AS before,
  position(o[step] IN 'ABCDE') AS own FROM o, (SELECT unnest(range(1, 6)) AS step) AS u),
e AS (SELECT part, o, step, own, n, n_good, n_toxic, n_fails, fails[own] AS bad,
  len([z FOR z IN before IF fails[z]]) > 0 AS gone FROM c, st),
r AS (SELECT part, o, step, own, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN gone AND bad THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN bad AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND bad THEN n_good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN NOT gone AND bad THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost FROM e GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""

_BLANKS = " || ".join(f"chr({k})" for k in (32, 9, 10, 11, 12, 13))

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, t, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS p FROM (
  SELECT r, doc_id, t, string_split(t, chr(10)) AS s FROM d) AS q),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') AS k FROM l),
hot AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k
  HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 't' || t)) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON hot.k = k.k GROUP BY r, doc_id"""
