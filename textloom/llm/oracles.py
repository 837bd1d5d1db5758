"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from .url_filter import _LOWER, _UPPER, RULES, SOFT, SOFT_LIMIT, STRICT

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY w) > 1 AS again FROM s),
b AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT b.doc_id, b.i, b.x,
  coalesce(max(CAST(f.again AS INT)) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.i = b.i),
a AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


_OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':42'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
  / CASE WHEN length(text) > 0 THEN greatest(length(regexp_replace(text, '\P{L}+', '', 'g'))::DOUBLE / length(text), 0.05) ELSE 1.0::DOUBLE END AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
  source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS pool FROM s),
l AS (SELECT *, cap <= (pool - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight AS is_full FROM w),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (pool - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0.0)) * weight
  / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM e),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, r.source_size, r.target,
  CAST(r.epochs * p.size + greatest(0, least(p.size, r.rest - p.before)) AS BIGINT) AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""


def _op10() -> str:
    url = f"translate(url, '{_UPPER}', '{_LOWER}')"
    strict = " + ".join(f"len(regexp_extract_all({url}, '(?:^|[^a-z0-9]){t}(?:$|[^a-z0-9])'))" for t in STRICT)
    soft = " + ".join(f"CASE WHEN regexp_matches({url}, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN {w} ELSE 0 END" for t, w in SOFT.items())
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, CAST(coalesce({strict}, 0) AS INT) AS strict_hits, CAST({soft} AS INT) AS soft_weight FROM pages)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_weight FROM u
"""


_OP12 = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.id % 50 = 0 AND a.id <> r.id AND len(a.v) = len(r.v)),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": _OP5, "op10_url_filter": _op10(), "op12_hard_negatives": _OP12, "op8_substring_dedup": _OP8}
