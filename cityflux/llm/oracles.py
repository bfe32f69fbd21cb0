"""SQL for the queries that SQL can express."""

ORACLES = {
    "op5_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id,
                sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size
            FROM n GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM n JOIN g USING (text_sha256)
    """,
    "op6_chat_format": r"""
        WITH m AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), c AS (
            SELECT conv_id,
                count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
                    + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS formatted_chars
            FROM m GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
            sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM c
    """,
}
