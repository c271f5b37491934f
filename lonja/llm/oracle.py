"""The registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str) -> str:
    return f"""SELECT {key}, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM {table}"""


def decontamination(documents: str = "documents") -> str:
    """Hits per document row; ``documents`` may be a subquery."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM ({_words(documents, "doc_id")})),
i AS ({_words("benchmark", "item_id")}),
p AS (SELECT DISTINCT item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM (
  SELECT item_id, w[s:s + least(13, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0))),
k AS (SELECT DISTINCT k FROM p),
s AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, k WHERE len(w) >= k),
m AS (SELECT s.r, s.s, s.k, p.item_id FROM (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM s) s
  JOIN p ON p.k = s.k AND p.g = s.g),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS q FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""


def _lines(documents: str) -> str:
    key = _LOWER.format(r"trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
    return f"""d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
l AS (SELECT doc_id, n, line, {key} AS k FROM
  (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM d)),
c AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.last_doc AS gone FROM l LEFT JOIN c ON l.k = c.k),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text FROM f GROUP BY doc_id)"""


def line_dedup(documents: str = "documents") -> str:
    return f"""WITH {_lines(documents)}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM t"""


_UNITS = """u AS (SELECT doc_id, n, u, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY n) AS stop,
  translate(regexp_replace(u, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(range(1, len(us) + 1)) AS n, unnest(us) AS u FROM
    (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE
      list_filter(string_split(regexp_replace(regexp_replace(text, '(\\n)', '\\1' || chr(1), 'g'), '([.!?] )', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')
      END AS us FROM documents)))"""

SUBSTRING_DEDUP = f"""WITH {_UNITS},
g AS (SELECT k, min(struct_pack(doc_id := doc_id, start := stop - length(u))) AS f FROM u
  WHERE octet_length(encode(k)) >= 40 GROUP BY k HAVING count(*) > 1),
r AS (SELECT u.*, stop - length(u) AS start, g.k IS NOT NULL
  AND (g.f.doc_id <> u.doc_id OR g.f.start <> stop - length(u)) AS gone FROM u LEFT JOIN g ON u.k = g.k)
SELECT d.doc_id, count(n) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE gone), '') AS removed,
sha256(coalesce(string_agg(u, '' ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id"""


def _integers(scale: int) -> str:
    return f"""list_transform(embedding, lambda v: floor({scale} * CAST(v AS DOUBLE)))"""


_USABLE = "coalesce(list_bool_and(list_transform(embedding, lambda v: coalesce(isfinite(CAST(v AS DOUBLE)), false))), true)"
_SQUARED = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _nearest(vectors: str, centroids: str) -> str:
    """Each vector's nearest centroid (ties: the smaller number) and squared distance."""
    near = _SQUARED.format("v.x", "c.c")
    return f"""SELECT r, min(q) AS q FROM (SELECT v.r, struct_pack(d := {near}, j := c.j) AS q FROM {vectors} v, {centroids} c) GROUP BY r"""


def clustering(k: int = 16, rounds: int = 3) -> str:
    steps = []
    for n in range(rounds):
        steps.append(f"""a{n} AS MATERIALIZED ({_nearest("v", f"c{n}")}),
m{n} AS (SELECT j, list(m ORDER BY i) AS c FROM (SELECT a.q.j AS j, i, floor(sum(v.x[i]) / count(*)) AS m
  FROM a{n} a JOIN v USING (r), unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY j),
c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m USING (j))""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_integers(64)} AS x FROM embeddings
  WHERE len(embedding) = 64 AND {_USABLE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS j, x AS c FROM
  (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k})),
{", ".join(steps)},
f AS (SELECT vec_id, a.q.j AS j, CAST(a.q.d AS BIGINT) AS d FROM ({_nearest("v", f"c{rounds}")}) a JOIN v USING (r))
SELECT vec_id, CAST(f.j AS INTEGER) AS cluster, d AS distance,
CAST(sum(d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(CAST(c.c AS BIGINT[]), ',')) AS centroid_sha256 FROM f JOIN c{rounds} c USING (j)"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64) -> str:
    width = dims // parts
    # |x - c|^2 as |x|^2 + (|c|^2 - 2 x.c): whole numbers below 2^53, so doubles are exact
    def near(n: int | str) -> str:
        far = "list_inner_product(p.x, p.x) + c.s - 2 * list_inner_product(p.x, c.c)"
        return f"""SELECT r, p, min(q) AS q FROM (SELECT p.r, p.p, struct_pack(d := {far}, j := c.j) AS q
  FROM p JOIN c{n} c USING (p)) GROUP BY r, p"""

    steps = []
    for n in range(rounds):
        steps.append(f"""a{n} AS MATERIALIZED ({near(n)}),
m{n} AS (SELECT p, j, list(m ORDER BY i) AS c FROM (SELECT p.p, a.q.j AS j, i, floor(sum(p.x[i]) / count(*)) AS m
  FROM a{n} a JOIN p ON a.r = p.r AND a.p = p.p, unnest(range(1, {width + 1})) AS t(i) GROUP BY ALL) GROUP BY p, j),
c{n + 1} AS MATERIALIZED (SELECT p, j, c, list_inner_product(c, c) AS s FROM
  (SELECT c.p, c.j, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m ON c.p = m.p AND c.j = m.j))""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_integers(1024)} AS x FROM embeddings
  WHERE len(embedding) = {dims} AND {_USABLE}),
p AS MATERIALIZED (SELECT r, p, x[p * {width} + 1:p * {width} + {width}] AS x FROM v, unnest(range(0, {parts})) AS t(p)),
k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS j, r FROM v QUALIFY j < {entries}),
c0 AS MATERIALIZED (SELECT p.p, k.j, p.x AS c, list_inner_product(p.x, p.x) AS s FROM k JOIN p USING (r)),
{", ".join(steps)},
f AS (SELECT r, string_agg(lower(printf('%02x', q.j)), '' ORDER BY p) AS code, CAST(sum(q.d) AS BIGINT) AS error
  FROM ({near(rounds)}) GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(CAST(c AS BIGINT[]), ','), ',' ORDER BY p, j)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT h FROM b) AS codebooks_sha256 FROM f JOIN v USING (r)"""


SQL = {
    "op4_decontamination": decontamination(),
    "op5_line_dedup": line_dedup(),
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op11_centroid_clustering": clustering(),
    "op12_vector_codes": vector_codes(),
}
