"""Queries of the reports over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import excerpt, slug, subject_tags
from lorespark.operators import reports as R
from lorespark.queries.base import NOW, E, S, entries, now, scored_entries

LEVELS = [0.3, 0.5, 0.7, 0.9]
KINDS = ["knowledge", "lesson", "decision", "pattern", "reflection"]
STATUSES = ["active", "fading", "superseded", "archived"]
_r = lambda c: F.round(c, 6).alias(c)

#: A vocabulary from before reflections and fading entries.
OLD_KINDS, OLD_STATUSES = [k for k in KINDS if k != "reflection"], [x for x in STATUSES if x != "fading"]


def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_entries(spark, sf_dir).select("id", _r("effective_confidence"))


def list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filtered(scored_entries(spark, sf_dir, "kind", "status", "tags", "source_agents"), kind="decision", status="active", all_tags=["retention"], least=0.1, most=0.9).select("id", _r("effective_confidence"))


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filtered(scored_entries(spark, sf_dir, "title", "body", "tags"), text=" Cold Start ", least=0.2).select("id", "title")


def agent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filtered(entries(spark, sf_dir, "kind", "source_agents"), agent="heron-cli").groupBy("kind").agg(F.count("*").alias("n"))


def entries_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(entries(spark, sf_dir, "title", "updated"), 50, 50).select("id", "title")


def recent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(entries(spark, sf_dir, "kind", "updated"), 0, 10).select("id", "kind")


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir, "tags", "source_agents")
    return R.counts_of(e, "tags", True).select(F.lit("tag").alias("facet"), "value").unionByName(R.counts_of(e, "source_agents", True).select(F.lit("agent").alias("facet"), "value"))


def _by(column: str, many: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.counts_of(entries(spark, sf_dir, column), column, many)

    return query


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_entries(spark, sf_dir, "status")
    review = (F.col("status") == "fading") | ((F.col("status") == "active") & (F.col("effective_confidence") < 0.4))
    return s.agg(
        F.count("*").alias("n_entries"), *[F.count_if(F.col("status") == x).alias(f"n_{x}") for x in STATUSES], F.count_if(review).alias("n_review"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"), F.round(F.coalesce(F.avg("effective_confidence"), F.lit(0.0)), 6).alias("mean_effective")
    )


def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(scored_entries(spark, sf_dir), "effective_confidence")


def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(scored_entries(spark, sf_dir), "effective_confidence").select("n", _r("mean"), _r("deviation"), _r("median"))


def confidence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.density(scored_entries(spark, sf_dir), "effective_confidence").select(_r("at"), _r("density"))


def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.above_levels(scored_entries(spark, sf_dir), "effective_confidence", LEVELS)


def activity_14d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.activity(entries(spark, sf_dir, "updated"), "updated", F.to_timestamp(F.lit("2025-06-30")))


def activity_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir, "updated")
    return e.groupBy(F.expr("extract(yearofweek from updated)").alias("iso_year"), F.weekofyear("updated").alias("iso_week"), F.year("updated").alias("calendar_year")).agg(F.count("*").alias("n"))


def long_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = facets(spark, sf_dir)
    return labels.groupBy("facet").agg(F.count("*").alias("n_labels"), F.count_if(F.octet_length("value") > 24).alias("n_long"), F.max(F.octet_length("value")).alias("longest"))


def ranked_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked_with_rest(R.counts_of(entries(spark, sf_dir, "tags"), "tags", True), 6)


def entry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with a vocabulary from before reflections and fading entries, so that some are broken."""
    return R.violations(entries(spark, sf_dir, "title", "confidence", "decay_rate", "kind", "status"), OLD_KINDS, OLD_STATUSES)


def entry_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir, "title", "body").select("id", slug(F.col("title")).alias("slug"), excerpt(F.col("body"), 80).alias("excerpt"))


def entry_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir, "tags").select("id", F.array_join(subject_tags(F.col("tags")), "|").alias("subjects"))


QUERIES = {
    "effective_confidence": effective,
    "list_filter": list_filter,
    "text_filter": text_filter,
    "agent_filter": agent_filter,
    "entries_page": entries_page,
    "recent_entries": recent_entries,
    "facets": facets,
    "stats_by_kind": _by("kind"),
    "stats_by_status": _by("status"),
    "stats_by_tag": _by("tags", True),
    "stats_by_agent": _by("source_agents", True),
    "overview": overview,
    "confidence_bins": confidence_bins,
    "confidence_summary": confidence_summary,
    "confidence_density": confidence_density,
    "confidence_levels": confidence_levels,
    "activity_14d": activity_14d,
    "activity_by_week": activity_by_week,
    "long_labels": long_labels,
    "ranked_tags": ranked_kinds,
    "entry_violations": entry_violations,
    "entry_excerpts": entry_excerpts,
    "entry_subjects": entry_subjects,
}

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
_FACETS = "f AS (SELECT DISTINCT 'tag' AS facet, unnest(tags) AS value FROM e UNION SELECT DISTINCT 'agent', unnest(source_agents) FROM e)"
_TAGS = "t AS (SELECT value, count(*) AS n FROM (SELECT DISTINCT id, unnest(tags) AS value FROM e) WHERE value IS NOT NULL GROUP BY value)"
SQL = {
    "effective_confidence": f"WITH {S} SELECT id, round(effective_confidence, 6) AS effective_confidence FROM s",
    "list_filter": f"WITH {S} SELECT id, round(effective_confidence, 6) AS effective_confidence FROM s WHERE kind = 'decision' AND status = 'active' AND list_contains(tags, 'retention') AND effective_confidence BETWEEN 0.1 AND 0.9",
    "text_filter": f"WITH {S} SELECT id, title FROM s WHERE (contains(lower(title), 'cold start') OR contains(lower(body), 'cold start') OR contains(lower(id), 'cold start') OR contains(lower(array_to_string(tags, chr(10))), 'cold start')) AND effective_confidence >= 0.2",
    "agent_filter": f"WITH {E} SELECT kind, count(*) AS n FROM e WHERE list_contains(source_agents, 'heron-cli') GROUP BY kind",
    "entries_page": f"WITH {E} SELECT id, title FROM e ORDER BY updated DESC, id LIMIT 50 OFFSET 50",
    "recent_entries": f"WITH {E} SELECT id, kind FROM e ORDER BY updated DESC, id LIMIT 10",
    "facets": f"WITH {E}, {_FACETS} SELECT facet, value FROM f WHERE value IS NOT NULL",
    "stats_by_kind": f"WITH {E} SELECT kind AS value, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY kind",
    "stats_by_status": f"WITH {E} SELECT status AS value, count(*) AS n FROM e WHERE status IS NOT NULL GROUP BY status",
    "stats_by_tag": f"WITH {E}, {_TAGS} SELECT value, n FROM t",
    "stats_by_agent": f"WITH {E} SELECT value, count(*) AS n FROM (SELECT DISTINCT id, unnest(source_agents) AS value FROM e) WHERE value IS NOT NULL GROUP BY value",
    "overview": f"WITH {S} SELECT count(*) AS n_entries, {', '.join(f'count(*) FILTER (status = {chr(39)}{x}{chr(39)}) AS n_{x}' for x in STATUSES)}, count(*) FILTER (status = 'fading' OR (status = 'active' AND effective_confidence < 0.4)) AS n_review, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, round(coalesce(avg(effective_confidence), 0), 6) AS mean_effective FROM s",
    "confidence_bins": f"WITH {S}, b AS (SELECT least(floor(effective_confidence * 10), 9)::INT AS bin, count(*) AS n FROM s WHERE effective_confidence IS NOT NULL GROUP BY 1) SELECT i::INT AS bin, coalesce(n, 0) AS n FROM range(10) r(i) LEFT JOIN b ON b.bin = i",
    "confidence_summary": f"WITH {S}, v AS (SELECT effective_confidence AS v, row_number() OVER (ORDER BY effective_confidence) - 1 AS r, count(*) OVER () AS n FROM s WHERE effective_confidence IS NOT NULL) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(max(v) FILTER (r = n // 2), 6) AS median FROM v",
    "confidence_density": f"WITH {S}, w AS (SELECT count(*) AS n, greatest(0.05, least(0.14, 0.75 / sqrt(count(*)))) AS h FROM s WHERE effective_confidence IS NOT NULL) SELECT round((i + 1) / 10.0, 6)::DOUBLE AS at, round(sum(exp(-0.5 * pow(((i + 1) / 10.0 - effective_confidence) / h, 2)) / (h * 2.5066282746310002)) / any_value(n), 6) AS density FROM s, w, range(10) r(i) WHERE effective_confidence IS NOT NULL GROUP BY i".replace(" AS at,", ' AS "at",'),
    "confidence_levels": " UNION ALL ".join(f"SELECT {x}::DOUBLE AS level, count(*) FILTER (effective_confidence >= {x}) AS n_above, count(*) FILTER (effective_confidence < {x}) AS n_below FROM ({f'WITH {S} SELECT effective_confidence FROM s'})" for x in LEVELS),
    "activity_14d": f"WITH {E}, d AS (SELECT (updated AT TIME ZONE 'UTC')::DATE AS day, count(*) AS n FROM e GROUP BY 1) SELECT (DATE '2025-06-30' - i::INT) AS day, coalesce(n, 0) AS n FROM range(14) r(i) LEFT JOIN d ON d.day = DATE '2025-06-30' - i::INT",
    "activity_by_week": f"WITH {E} SELECT isoyear(updated AT TIME ZONE 'UTC') AS iso_year, week(updated AT TIME ZONE 'UTC') AS iso_week, year(updated AT TIME ZONE 'UTC') AS calendar_year, count(*) AS n FROM e GROUP BY ALL",
    "long_labels": f"WITH {E}, {_FACETS} SELECT facet, count(*) AS n_labels, count(*) FILTER (strlen(value) > 24) AS n_long, max(strlen(value)) AS longest FROM f WHERE value IS NOT NULL GROUP BY facet",
    "ranked_tags": f"WITH {E}, {_TAGS}, r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS r FROM t) SELECT CASE WHEN r <= 6 THEN value ELSE 'others' END AS value, sum(n)::BIGINT AS n, count(*) AS n_values FROM r GROUP BY 1",
    "entry_violations": f"""WITH {E}, p AS (SELECT id, unnest([CASE WHEN trim(coalesce(id, '')) = '' THEN 'blank id' END, CASE WHEN trim(coalesce(title, '')) = '' THEN 'blank title' END, CASE WHEN strlen(title) > 240 THEN 'long title' END,
CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence out of range' END, CASE WHEN coalesce(decay_rate < 0, true) THEN 'negative decay rate' END,
CASE WHEN NOT coalesce(kind IN ({_in(OLD_KINDS)}), false) THEN 'unknown kind' END, CASE WHEN NOT coalesce(status IN ({_in(OLD_STATUSES)}), false) THEN 'unknown status' END]) AS problem FROM e) SELECT id, problem FROM p WHERE problem IS NOT NULL""",
    "entry_excerpts": f"""WITH {E}, x AS (SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS sl, trim(regexp_replace(regexp_replace(body, '^\\s*#[^\\n]*', ''), '\\s+', ' ', 'g')) AS b FROM e)
SELECT id, CASE WHEN sl = '' THEN 'entry' ELSE sl END AS slug, CASE WHEN length(b) > 80 THEN left(b, 80) || '…' ELSE b END AS excerpt FROM x""",
    "entry_subjects": f"WITH {E} SELECT id, array_to_string(list_sort(list_distinct(list_filter(tags, lambda t: t IS NOT NULL AND NOT contains(t, ':')))), '|') AS subjects FROM e",
}
