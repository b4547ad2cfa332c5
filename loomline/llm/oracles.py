"""SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_ONE = "one AS (SELECT * FROM problems WHERE problem_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY pos) = 1)"
_PAIRS = f"""{_ONE},
w AS (SELECT problem_id, source_id, regexp_extract_all(lower(coalesce(prompt, '') || ' ' || coalesce(reference_code, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM one),
s AS (SELECT problem_id, source_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
e AS (SELECT problem_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (SELECT a.problem_id AS a, b.problem_id AS b FROM e a JOIN e b ON a.g = b.g AND a.problem_id < b.problem_id
          GROUP BY 1, 2 HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5),
side AS (SELECT problem_id, CASE WHEN source_id LIKE 'train:%' THEN 1 WHEN source_id LIKE 'test:%' OR source_id LIKE 'valid:%' THEN 2 ELSE 0 END AS side FROM one),
across AS (SELECT a, b FROM pairs JOIN side x ON x.problem_id = a JOIN side y ON y.problem_id = b WHERE x.side + y.side = 3 AND x.side * y.side = 2)"""

ORACLES = {
    "p1_found": f"WITH {_PAIRS} SELECT a AS problem_id_a, b AS problem_id_b FROM across",
    "p1_report": f"""WITH {_PAIRS}, hit AS (SELECT a AS problem_id FROM across UNION SELECT b FROM across)
SELECT CASE WHEN contains(source_id, ':') THEN split_part(source_id, ':', 1) ELSE 'none' END AS split, lower(trim(source)) AS source, count(*) AS problems, count(hit.problem_id) AS overlapping, count(hit.problem_id) / count(*) AS share
FROM one LEFT JOIN hit USING (problem_id) GROUP BY 1, 2""",
    "p4_found": f"WITH {_PAIRS} SELECT a AS problem_id_a, b AS problem_id_b FROM pairs",
    "p4_classes": f"""WITH RECURSIVE {_PAIRS}, k AS (SELECT problem_id, array_to_string(w, ' ') AS words FROM w WHERE len(w) >= 3),
c AS (SELECT problem_id, words, min(problem_id) OVER (PARTITION BY words) AS class_id, count(*) OVER (PARTITION BY words) AS copies FROM k),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
links AS (SELECT a AS problem_id, count(*) FILTER (WHERE x.words <> y.words) AS links FROM both_ways JOIN k x ON x.problem_id = a JOIN k y ON y.problem_id = b GROUP BY 1),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT c.problem_id, class_id, copies, links, (SELECT min(b) FROM reach WHERE reach.a = c.problem_id) AS group_id FROM c JOIN links USING (problem_id)""",
}
