"""The registered queries that SQL can state, for DuckDB."""

from __future__ import annotations

# Seats are listed one by one here, where the operator lists only the open ones.
MIX = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS salt FROM documents),
tot AS (SELECT sum(size)::BIGINT AS total, ceil(sum(size) / 16)::BIGINT AS seats FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][src % 3 + 1]::BIGINT AS w, 3 * source_size AS most FROM sources),
early AS (SELECT *, total - coalesce(sum(most) OVER before, 0)::BIGINT AS rest, (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS ws FROM weighed, tot
  WINDOW before AS (ORDER BY most / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT rest, ws, most / w AS r, src AS s FROM early WHERE rest * w <= most * ws ORDER BY most / w, src LIMIT 1),
goal AS (SELECT e.source, e.source_size, e.src, e.seats, ceil(sqrt(ceil(e.docs / 256)))::BIGINT AS side,
    CASE WHEN e.most / e.w > o.r OR (e.most / e.w = o.r AND e.src >= o.s) THEN e.w::DOUBLE * o.rest::DOUBLE / o.ws::DOUBLE ELSE e.most::DOUBLE END AS target
  FROM early e LEFT JOIN opened o ON TRUE),
blocks AS (SELECT src, count(*) AS seats FROM (SELECT src, seats, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, src) AS place
    FROM (SELECT src, target, seats, unnest(range(1, seats + 1)) AS k FROM goal WHERE target > 0)) WHERE place <= seats GROUP BY src),
placed AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.src, g.target, md5('7:' || coalesce(d.doc_id::VARCHAR, '-' || d.salt)) AS key,
    ('0x' || substr(key, 1, 7))::BIGINT % side AS a, ('0x' || substr(key, 8, 7))::BIGINT % side AS b
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
shards AS (SELECT src, a, b, sum(size)::BIGINT AS words FROM placed GROUP BY src, a, b),
halls AS (SELECT src, a, sum(words)::BIGINT AS words FROM shards GROUP BY src, a),
hall_seats AS (SELECT src, a, count(*) AS seats FROM (SELECT src, a, seats, row_number() OVER (PARTITION BY src ORDER BY words::DOUBLE / (2 * k - 1) DESC, a) AS place
    FROM (SELECT h.src, a, words, seats, unnest(range(1, seats + 1)) AS k FROM halls h JOIN blocks USING (src) WHERE words > 0)) WHERE place <= seats GROUP BY src, a),
quotas AS (SELECT src, a, b, count(*) AS quota FROM (SELECT src, a, b, seats, row_number() OVER (PARTITION BY src, a ORDER BY words::DOUBLE / (2 * k - 1) DESC, b) AS place
    FROM (SELECT s.src, s.a, b, words, seats, unnest(range(1, seats + 1)) AS k FROM shards s JOIN hall_seats USING (src, a) WHERE words > 0)) WHERE place <= seats GROUP BY src, a, b),
runs AS (SELECT src, a, b, n, least(coalesce(quota, 0), 3 * n) AS q, CASE WHEN n > 0 THEN q // n ELSE 0 END AS whole,
    CASE WHEN n > 0 THEN ('0x' || substr(md5(concat_ws(':', '7', src, a, b)), 1, 7))::BIGINT % n ELSE 0 END * 16 AS first, first + (q - whole * n) * 16 AS last, n * 16 AS ring
  FROM (SELECT s.src, s.a, s.b, ceil(words / 16)::BIGINT AS n, quota FROM shards s LEFT JOIN quotas USING (src, a, b))),
ordered AS (SELECT *, (sum(size) OVER (PARTITION BY src, a, b ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS till FROM placed)
SELECT doc_id, source, size, source_size, target,
  (whole * size + greatest(0, least(till, last) - greatest(till - size, first)) + greatest(0, least(till, last - ring) - (till - size)))::BIGINT AS taken
FROM ordered JOIN runs USING (src, a, b)"""

# Units are listed whole and joined again where they are cut.
MIDDLE = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM units),
cut AS (SELECT doc_id, n, t,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut"""

NEGATIVES = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER own::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW own AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER own <= 3"""

SQL: dict[str, str] = {"op1_mix_sources": MIX, "op12_hard_negatives": NEGATIVES, "op13_fill_in_middle": MIDDLE}
