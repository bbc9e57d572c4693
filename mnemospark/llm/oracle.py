"""SQL twins of the llm queries that SQL can express on whole tables."""

ORACLE: dict[str, str] = {
    "p1_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1000",
    "p7_found": r"""
WITH one AS (
  SELECT chunk_id, any_value(conversation_id) AS conversation_id, any_value(user_id) AS user_id, any_value(timestamp) AS eff,
         any_value(speaker) AS speaker, any_value(extra) AS extra, any_value(text) AS text
  FROM chunks WHERE chunk_id IS NOT NULL AND trim(coalesce(conversation_id, '')) <> '' GROUP BY chunk_id),
m AS (
  SELECT one.*, s.speaker_role AS role,
         list_position(['system', 'user', 'tool', 'assistant'], s.speaker_role) AS r,
         CASE WHEN json_valid(extra) THEN json_extract_string(extra, '$.reply_to') END AS parent,
         text IS NULL OR regexp_full_match(text, '[\s\p{Z}\p{C}]*') AS blank
  FROM one LEFT JOIN speaker_aliases s
    ON s.alias_text = lower(regexp_replace(regexp_replace(speaker, '^\s+|\s+$', '', 'g'), ':$', ''))),
f AS (
  SELECT conversation_id, bool_or(eff IS NULL OR role IS NULL) AS bad, count(DISTINCT coalesce(user_id, '')) AS users,
         max(CASE WHEN NOT blank AND role = 'user' THEN (eff, r, chunk_id) END) AS asked,
         max(CASE WHEN NOT blank AND role = 'assistant' THEN (eff, r, chunk_id) END) AS answered
  FROM m GROUP BY conversation_id),
o AS (
  SELECT DISTINCT conversation_id FROM m
  WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m p WHERE p.conversation_id = m.conversation_id AND p.chunk_id = m.parent))
SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY eff, r, chunk_id) AS INTEGER) AS turn_no, chunk_id
FROM m JOIN f USING (conversation_id)
WHERE NOT blank AND NOT bad AND users = 1 AND answered > asked AND conversation_id NOT IN (SELECT conversation_id FROM o)
""",
}
