"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MERKLE = f"""WITH RECURSIVE base AS MATERIALIZED (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, * FROM (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS run, {_leaf('n_chars')} AS leaf,
      CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS bad, lang FROM documents)),
tree AS (SELECT run, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY run) AS n FROM base
  UNION ALL SELECT run, level + 1, pos // 2, sha256(h || coalesce(follower, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY run ORDER BY pos) AS follower FROM tree WHERE n > 1) WHERE pos % 2 = 0),
subroots AS MATERIALIZED (SELECT run, h AS subroot, row_number() OVER (ORDER BY run) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS h, n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(h || coalesce(follower, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS follower FROM top WHERE n > 1) WHERE pos % 2 = 0),
nodes AS MATERIALIZED (SELECT run, level, pos, h, n, false AS upper FROM tree WHERE n > 1 UNION ALL SELECT '', 1000 + level, pos, h, n, true FROM top WHERE n > 1),
levels AS MATERIALIZED (SELECT DISTINCT run, level, upper FROM nodes),
steps AS MATERIALIZED (SELECT b.run, b.pos, row_number() OVER (PARTITION BY b.run, b.pos ORDER BY l.level) AS step, k.h AS sibling, p.place % 2 AS side
  FROM base b JOIN subroots s USING (run) JOIN levels l ON l.upper OR l.run = b.run
  CROSS JOIN LATERAL (SELECT CASE WHEN l.upper THEN s.pos // (1 << (l.level - 1000)) ELSE b.pos // (1 << l.level) END AS place) p
  LEFT JOIN nodes k ON k.upper = l.upper AND k.level = l.level AND k.run = l.run AND k.pos = xor(p.place, 1)),
folds AS (SELECT run, pos, 0::BIGINT AS step, coalesce(bad, leaf) AS h FROM base
  UNION ALL SELECT f.run, f.pos, s.step, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.side = 1 THEN s.sibling || f.h ELSE f.h || s.sibling END)
  FROM folds f JOIN steps s ON s.run = f.run AND s.pos = f.pos AND s.step = f.step + 1),
proofs AS (SELECT run, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256, count(*) AS n FROM steps GROUP BY 1, 2)
SELECT b.doc_id, b.leaf, s.subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM base b JOIN subroots s USING (run) JOIN (SELECT h FROM top WHERE n = 1) r ON true LEFT JOIN proofs p ON p.run = b.run AND p.pos = b.pos
JOIN folds f ON f.run = b.run AND f.pos = b.pos AND f.step = coalesce(p.n, 0)"""


def _nearest(r: int) -> str:
    """Every part with its nearest entry of codebook ``r``."""
    return f"""d{r} AS MATERIALIZED (SELECT x.id, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{r} c ON x.p = c.p),
a{r} AS MATERIALIZED (SELECT id, p, min({{'d': d, 'e': e}}) AS m FROM d{r} GROUP BY 1, 2)"""


def _moved(r: int) -> str:
    """Codebook ``r + 1`` from the parts of each entry."""
    return f"""s{r} AS (SELECT p, e, i, mean AS v FROM (SELECT a.p, a.m.e AS e, u.i AS i, (sum(x.v[u.i]) - ((sum(x.v[u.i]) % count(*)) + count(*)) % count(*)) // count(*) AS mean
  FROM a{r} a JOIN x ON x.id = a.id AND x.p = a.p CROSS JOIN (SELECT unnest(range(1, w + 1)) AS i FROM dims) u GROUP BY ALL)),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT p, e, list(v::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY 1, 2) m ON m.p = c.p AND m.e = c.e)"""


VECTOR_CODES = """WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS id, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
dims AS (SELECT len(v) // 4 AS w FROM kept LIMIT 1),
x AS MATERIALIZED (SELECT id, p, v[p * w + 1 : (p + 1) * w] AS v FROM kept, dims, range(4) r(p)),
c0 AS MATERIALIZED (SELECT p, id AS e, v FROM x WHERE id < 256),
""" + ",\n".join(_nearest(r) + ",\n" + _moved(r) for r in range(4)) + ",\n" + _nearest(4) + """,
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM c4),
codes AS (SELECT id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a4 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM codes JOIN kept USING (id), digest"""
