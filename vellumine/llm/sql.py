"""DuckDB twins of those training-data queries that SQL can express."""

from __future__ import annotations

_P4 = """
WITH last AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY scored_at DESC NULLS LAST, prob DESC NULLS LAST,
      pos ASC NULLS LAST, label ASC NULLS LAST, paper_id ASC NULLS LAST) AS rn
    FROM ssc_preds WHERE pred_id IS NOT NULL) WHERE rn = 1),
ok AS (
  SELECT pred_id, paper_id, pos, prob, sentence,
    upper(substr(split_part(label, '_', 1), 1, 1)) || lower(substr(split_part(label, '_', 1), 2)) AS label
  FROM last WHERE paper_id IS NOT NULL AND label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1),
top AS (
  SELECT *, row_number() OVER (PARTITION BY paper_id, label ORDER BY prob DESC, pos ASC NULLS LAST, pred_id ASC) AS k FROM ok)
"""

_STRETCH = r"list_max(list_transform(regexp_split_to_array({0}, '[\s\p{{Z}}\x0b\x1c-\x1f\x85。！？；，、।؟]'), lambda x: length(x)))"


def oracle_sql() -> dict[str, str]:
    body, part = _STRETCH.format("body"), _STRETCH.format("s")
    return {
        "p2_found": f"""
SELECT 'sections' AS src, section_id AS row_id, CAST(-1 AS INTEGER) AS pos,
  CASE WHEN {body} > 1800 THEN 'hard' ELSE 'soft' END AS cut
FROM sections WHERE length(body) > 1800
UNION ALL
SELECT 'ssc_input', input_id, CAST(i AS INTEGER), CASE WHEN {part} > 320 THEN 'hard' ELSE 'soft' END
FROM (SELECT input_id, unnest(range(len(sentences))) AS i, unnest(sentences) AS s FROM ssc_input)
WHERE length(s) > 320""",
        "p4_found": _P4 + "SELECT pred_id FROM top WHERE k <= 5",
        "p4_sentences": _P4 + "SELECT pred_id, paper_id, label, pos, prob, sentence FROM top WHERE k <= 5",
        "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
        "p8_found": r"""
WITH d AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, coalesce(strlen(text), 0) AS size
           FROM documents WHERE source IS NOT NULL),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY source),
t AS (SELECT sum(size) AS total FROM d)
SELECT m.source, CASE WHEN m.target_share * t.total <= coalesce(s.size, 0) THEN 'reduced'
  WHEN m.target_share * t.total <= m.max_repeats * coalesce(s.size, 0) THEN 'repeated' ELSE 'capped' END AS outcome
FROM mix_targets m CROSS JOIN t LEFT JOIN s ON s.source = lower(trim(m.source))""",
    }
