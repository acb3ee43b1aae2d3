"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.operators.orphans import orphan_references, orphan_report, vault_references
from lorespark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of entries and queue items that leads nowhere, was removed or arrived late."""
    entries = table(spark, sf_dir, "entries")
    refs = vault_references(entries, table(spark, sf_dir, "queue_items"))
    return orphan_references(refs, entries.select("id", "loaded_at"), table(spark, sf_dir, "removals"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per table, field, reason and month."""
    return orphan_report(p1_found(spark, sf_dir))


_FOUND = r"""
WITH e AS (SELECT id, min(loaded_at) AS loaded_at, min(updated) AS ref_time, any_value(supersedes) AS supersedes, any_value(superseded_by) AS superseded_by, any_value(links) AS links FROM entries WHERE id IS NOT NULL GROUP BY id),
q AS (SELECT id, min(loaded_at) AS loaded_at, min(updated_at) AS ref_time, any_value(candidate.distillation.related_entry_ids) AS related FROM queue_items WHERE id IS NOT NULL GROUP BY id),
raw AS (
  SELECT 'entries' AS source_table, id AS record_id, 'supersedes' AS field_name, unnest(supersedes) AS target, loaded_at, ref_time FROM e
  UNION ALL SELECT 'entries', id, 'links', unnest(links), loaded_at, ref_time FROM e
  UNION ALL SELECT 'entries', id, 'superseded_by', superseded_by, loaded_at, ref_time FROM e
  UNION ALL SELECT 'queue_items', id, 'related_entry_ids', unnest(related), loaded_at, ref_time FROM q),
refs AS (SELECT DISTINCT source_table, record_id, field_name, regexp_replace(target, '^\s+|\s+$', '', 'g') AS target_id, loaded_at, ref_time FROM raw WHERE regexp_replace(target, '^\s+|\s+$', '', 'g') <> ''),
judged AS (
  SELECT r.*, CASE WHEN m.removed_at <= r.ref_time THEN 'deleted' WHEN t.id IS NULL THEN 'missing' WHEN t.loaded_at > r.loaded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN e t ON t.id = r.target_id LEFT JOIN (SELECT entry_id, min(removed_at) AS removed_at FROM removals GROUP BY entry_id) m ON m.entry_id = r.target_id)
SELECT source_table, record_id, field_name, target_id, reason, strftime(ref_time AT TIME ZONE 'UTC', '%Y-%m') AS period FROM judged WHERE reason IS NOT NULL
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _FOUND,
    "p1_report": f"""SELECT source_table, field_name, reason, period, count(*) AS n_references, count(DISTINCT record_id) AS n_records, count(DISTINCT target_id) AS n_targets
FROM ({_FOUND}) GROUP BY source_table, field_name, reason, period""",
}
