"""DuckDB forms of the canonical tables, to be put before a twin's SELECT."""

from __future__ import annotations

CLEAN = r"regexp_replace(replace(regexp_replace({0}, '[^\x00-\x7F]', '', 'g'), '- ', ''), '^\s+|\s+$', '', 'g')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

_PAGES = """_p AS (SELECT record_id, unnest(range(len(pages))) AS page_pos, unnest(pages) AS p FROM layouts),
pages_v AS (SELECT record_id, page_pos, p.width AS width, p.height AS height, p.index AS index FROM _p WHERE p IS NOT NULL)"""
_OK = "len({0}) = 4 AND NOT list_contains(list_transform({0}, lambda v: v IS NULL), true)"
_BLOCKS = f"""_b AS (SELECT record_id, page_pos, p, unnest(range(len(p.layout.bundles))) AS block_id, unnest(p.layout.bundles) AS b FROM _p),
blocks AS (SELECT record_id, page_pos, block_id, b.type AS type, b.bbox[1] AS x1, b.bbox[2] AS y1, b.bbox[3] AS x2, b.bbox[4] AS y2, b.confidence AS confidence
  FROM _b WHERE {_OK.format("b.bbox")})"""
_TOKENS = f"""_t AS (SELECT record_id, page_pos, p.width AS pw, p.height AS ph, block_id AS parent, unnest(range(len(b.tokens))) AS k, unnest(b.tokens) AS t FROM _b
  UNION ALL SELECT record_id, page_pos, p.width, p.height, NULL, unnest(range(len(p.layout.remaining_tokens))), unnest(p.layout.remaining_tokens) FROM _p),
tokens AS (SELECT record_id, page_pos, row_number() OVER (PARTITION BY record_id, page_pos ORDER BY parent ASC NULLS LAST, k) - 1 AS token_id, parent,
  t.text AS text, t.type AS type, t.confidence AS confidence, t.bbox[1] AS x1, t.bbox[2] AS y1, t.bbox[3] AS x2, t.bbox[4] AS y2, pw, ph
  FROM _t WHERE {_OK.format("t.bbox")})"""
LAYOUT = f"WITH {_PAGES},\n{_BLOCKS},\n{_TOKENS}"


def _sentences(name: str, source: str, keys: str, text: str, more: str = "") -> str:
    return rf"""_s_{name} AS (SELECT {keys}, regexp_extract_all({CLEAN.format(text)}, '[^.!?\n]+[.!?]*') AS ss FROM {source}),
_u_{name} AS (SELECT * EXCLUDE (ss), unnest(range(len(ss))) AS sent_id, unnest(ss) AS s FROM _s_{name}),
{name} AS (SELECT * EXCLUDE (s), {STRIP.format("s")} AS text{more} FROM _u_{name} WHERE {STRIP.format("s")} <> '')"""


DOCS = "WITH " + _sentences("sents", "documents", "doc_id", "text", ", sent_id // 5 AS block_id")
PAPERS = "WITH " + _sentences("sents", "sections", "paper_id, section_id AS block_id, lower(header) AS section", "body")
PREDS = """WITH preds AS (SELECT pred_id, paper_id, pos, sentence, upper(substr(split_part(label, '_', 1), 1, 1)) || lower(substr(split_part(label, '_', 1), 2)) AS label,
  prob, pos // 10 AS block_id, scored_at FROM ssc_preds
  WHERE paper_id IS NOT NULL AND label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1)"""
SCORES = "WITH scores AS (SELECT vec_id, CAST(embedding[1:5] AS DOUBLE[]) AS logits, label FROM embeddings)"
