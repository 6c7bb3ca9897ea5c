"""Queries of the general training-data operators."""

from __future__ import annotations

from tidemark.operators import deliveries, snapshots, timestamps
from tidemark.session import table


def p1_found(spark, sf_dir):
    return timestamps.instants(
        table(spark, sf_dir, "evidence_history"),
        table(spark, sf_dir, "text_sections"),
        table(spark, sf_dir, "targets"),
        table(spark, sf_dir, "sites"),
        table(spark, sf_dir, "zone_abbrevs"),
    )


def p4_found(spark, sf_dir):
    return snapshots.snapshot_changes(table(spark, sf_dir, "manifests"), table(spark, sf_dir, "facts"))


def p5_found(spark, sf_dir):
    return deliveries.surplus_deliveries(
        table(spark, sf_dir, "webhook_payloads"), table(spark, sf_dir, "digest_changes")
    )


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found}

ORACLE = {
    # Arrays of texts are the only arrays in the tables, so their elements are compared as texts.
    "p4_found": """
        WITH m AS (SELECT target_identity, generation, min(created_at) AS c FROM manifests WHERE manifest_kind = 'trusted' GROUP BY 1, 2),
        s AS (SELECT target_identity, generation, row_number() OVER w AS idx, lead(generation) OVER w AS next_g FROM m
              WINDOW w AS (PARTITION BY target_identity ORDER BY c, generation)),
        f AS (SELECT target_identity, generation, fact_id, CASE
                  WHEN fact_value IS NULL THEN 'null' WHEN NOT json_valid(fact_value) THEN 'raw:' || fact_value
                  WHEN json_type(fact_value) = 'VARCHAR' THEN 's' || nfc_normalize(fact_value ->> '$')
                  WHEN json_type(fact_value) = 'ARRAY' THEN 'a' || nfc_normalize(CAST(json_extract_string(fact_value, '$[*]') AS VARCHAR))
                  WHEN json_type(fact_value) IN ('BOOLEAN', 'NULL') THEN trim(fact_value)
                  ELSE 'd' || CAST(CAST(trim(fact_value) AS DOUBLE) + 0.0 AS VARCHAR) END AS v
              FROM facts QUALIFY row_number() OVER (PARTITION BY target_identity, generation, fact_id ORDER BY ord, fact_row) = 1),
        k AS (SELECT f.*, s.idx, s.next_g, lag(s.idx) OVER w AS prev_idx, lag(v) OVER w AS prev_v, lead(s.idx) OVER w AS next_idx
              FROM f JOIN s USING (target_identity, generation) WINDOW w AS (PARTITION BY target_identity, fact_id ORDER BY s.idx))
        SELECT target_identity, generation, fact_id, CASE WHEN prev_idx = idx - 1 THEN 'changed' ELSE 'added' END AS change_kind
        FROM k WHERE (prev_idx = idx - 1 AND v <> prev_v) OR (idx > 1 AND (prev_idx IS NULL OR prev_idx < idx - 1))
        UNION ALL SELECT target_identity, next_g, fact_id, 'removed' FROM k
        WHERE next_g IS NOT NULL AND (next_idx IS NULL OR next_idx > idx + 1)""",
    "p5_found": """
        WITH p AS (
            SELECT payload_row, nullif(lower(regexp_replace(delivery_id, '^\\s+|\\s+$', '', 'g')), '') AS ident,
                   try_cast(generated_at AS TIMESTAMPTZ) AS instant
            FROM webhook_payloads),
        c AS (
            SELECT d.change_row, nullif(lower(regexp_replace(d.change_id, '^\\s+|\\s+$', '', 'g')), '') AS ident, p.instant
            FROM digest_changes d LEFT JOIN p ON p.payload_row = d.payload_row)
        SELECT 'payload' AS rec_kind, payload_row AS row_no FROM p WHERE ident IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ident ORDER BY instant NULLS LAST, payload_row) > 1
        UNION ALL
        SELECT 'change', change_row FROM c WHERE ident IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ident ORDER BY instant NULLS LAST, change_row) > 1""",
}
