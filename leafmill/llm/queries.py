"""The queries of the training-text problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import garbled, langid, markup, mix, pack, sentences, split, unify


def queries() -> dict:
    return {
        "p1_found": langid.p1_found,
        "p1_stretches": langid.p1_stretches,
        "p2_found": markup.p2_found,
        "p2_clean": markup.p2_clean,
        "p3_found": unify.p3_found,
        "p3_unified": unify.p3_unified,
        "p4_found": sentences.p4_found,
        "p4_sentences": sentences.p4_sentences,
        "p5_found": split.p5_found,
        "p5_pieces": split.p5_pieces,
        "p5_whole": split.p5_whole,
        "p6_found": pack.p6_found,
        "p6_containers": pack.p6_containers,
        "p6_fill": pack.p6_fill,
        "p6_whole": pack.p6_whole,
        "p7_found": mix.p7_found,
        "p7_shares": mix.p7_shares,
        "p7_copies": mix.p7_copies,
        "p7_whole": mix.p7_whole,
        "p8_found": garbled.p8_found,
        "p8_restored": garbled.p8_restored,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": """
            WITH limits AS (
              SELECT 'keep' AS job_kind, job_id, max(prepared.batchMaximumChars) AS max_chars FROM keep_jobs GROUP BY job_id
              UNION ALL
              SELECT 'ar', job_id, max(prepared.batchMaximumChars) FROM ar_jobs GROUP BY job_id)
            SELECT DISTINCT u.unit_key FROM job_units u JOIN limits l ON u.job_kind = l.job_kind AND u.job_id = l.job_id
            WHERE length(u.source) > l.max_chars""",
        "p5_whole": """
            WITH limits AS (
              SELECT 'keep' AS job_kind, job_id, max(prepared.batchMaximumChars) AS max_chars FROM keep_jobs GROUP BY job_id
              UNION ALL
              SELECT 'ar', job_id, max(prepared.batchMaximumChars) FROM ar_jobs GROUP BY job_id)
            SELECT DISTINCT u.unit_key, CAST(length(u.source) AS INTEGER) AS characters, true AS fits, true AS whole
            FROM job_units u JOIN limits l ON u.job_kind = l.job_kind AND u.job_id = l.job_id WHERE length(u.source) > l.max_chars""",
        "p6_whole": """
            SELECT p.pack_id, count(*) AS documents, CAST(sum(strlen(d.text)) AS BIGINT) AS tokens, true AS fits
            FROM documents d CROSS JOIN pack_sizes p WHERE d.text IS NOT NULL GROUP BY p.pack_id""",
        "p7_whole": "SELECT mix_id, source, true AS capped, true AS near FROM mix_targets",
        "p6_found": """
            SELECT DISTINCT p.pack_id, d.doc_id FROM documents d JOIN pack_sizes p ON strlen(d.text) > p.capacity_tokens""",
        "p7_found": """
            WITH s AS (SELECT source, sum(strlen(text)) AS tokens FROM documents WHERE source IS NOT NULL GROUP BY source),
                 t AS (SELECT sum(tokens) AS all_tokens FROM s)
            SELECT DISTINCT m.mix_id, m.source FROM mix_targets m LEFT JOIN s ON m.source = s.source CROSS JOIN t
            WHERE m.max_repeats * coalesce(s.tokens, 0) < m.target_weight * t.all_tokens""",
    }
