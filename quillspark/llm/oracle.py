"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLE: dict[str, str] = {
    "p1_found": """
WITH items AS (
  SELECT 'evidence' AS item_kind, evidence_id AS item_key, content FROM evidence_units
  UNION ALL SELECT 'page', document_id || ':p' || page_number, text FROM parsed_pages
  UNION ALL SELECT 'snippet', 'b' || lpad(CAST(bundle_id AS VARCHAR), 10, '0') || ':' || (i - 1), snippets[i]
  FROM (SELECT bundle_id, snippets, unnest(generate_series(1, len(snippets))) AS i FROM context_bundles))
SELECT DISTINCT item_kind, item_key FROM items JOIN split_limits USING (item_kind) WHERE length(content) > max_chars
""",
    "p1_whole": """
WITH items AS (
  SELECT 'evidence' AS item_kind, evidence_id AS item_key, content FROM evidence_units
  UNION ALL SELECT 'page', document_id || ':p' || page_number, text FROM parsed_pages
  UNION ALL SELECT 'snippet', 'b' || lpad(CAST(bundle_id AS VARCHAR), 10, '0') || ':' || (i - 1), snippets[i]
  FROM (SELECT bundle_id, snippets, unnest(generate_series(1, len(snippets))) AS i FROM context_bundles))
SELECT DISTINCT item_kind, item_key, md5(content) AS digest, true AS fits FROM items JOIN split_limits USING (item_kind) WHERE length(content) > max_chars
""",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM documents",
}
