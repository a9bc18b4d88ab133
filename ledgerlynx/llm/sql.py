"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .url_filter import SOFT_LIMIT, SOFT_TERMS, STRICT_TERMS


def _hits(terms: tuple[str, ...], hit: str) -> str:
    """The sum over the terms of an expression of the parts that a term cuts the URL into between boundaries.

    Every boundary is doubled, so that two terms may share one."""
    return " + ".join(hit.format(f"(len(string_split(u, '_{t}_')) - 1)") for t in terms)


_URLS = f"""
WITH cut AS (
  SELECT page_id, '_' || regexp_replace(translate(coalesce(url_decode(replace(url, '+', '%2B')), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]', '__', 'g') || '_' AS u,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, u,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM parts),
counted AS (
  SELECT *, ({_hits(STRICT_TERMS, '{}')})::INT AS n_strict, ({_hits(SOFT_TERMS, '({} > 0)::INT')})::INT AS n_soft
  FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM counted
"""

_JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.to_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.to_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, e::DOUBLE[] AS e, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS r
  FROM (SELECT vec_id, label, embedding AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.r > 0 AND b.r > 0 AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS to_id FROM embeddings UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.to_id),
c AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) k ON k.u = e.vec_id JOIN c ON c.id = e.vec_id
"""

_NEGATIVES = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE a.id % 50 = 0),
good AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT g.anchor_id, g.id AS positive_id, (row_number() OVER w)::INT AS rank, n.id AS negative_id, g.score AS positive_score, n.score AS negative_score
FROM good g JOIN scored n ON n.anchor_id = g.anchor_id AND NOT n.same AND 50 * g.score <= 100 * n.score AND 100 * n.score <= 95 * g.score
WINDOW w AS (PARTITION BY g.anchor_id, g.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""

ORACLES = {"op3_embedding_near_dedup": _VECTORS, "op7_ngram_jaccard_join": _JACCARD, "op8_url_filters": _URLS, "op11_hard_negative_mining": _NEGATIVES}
