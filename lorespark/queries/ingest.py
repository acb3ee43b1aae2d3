"""Queries of sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.copies import earliest_copy
from lorespark.queries.base import E, entries
from lorespark.schema import ENTRY
from lorespark.session import table
from lorespark.sources.logs import note_points, parse_task_logs, task_log_lines, transcript_turns
from lorespark.sources.vault import parse_entries, render_entries
from lorespark.streaming.captures import capture_stream, deliveries
from lorespark.streaming.windows import event_stream, run_available, user_sessions, windowed


def _micros(column: str):
    """A time as microseconds, which compares alike whatever the time zone of a client."""
    return F.unix_micros(column).alias(column)


def vault_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries rendered as Markdown files and parsed again."""
    parsed = parse_entries(render_entries(entries(spark, sf_dir, *ENTRY.names)))
    return parsed.select("id", "kind", "title", "confidence", F.size("tags").alias("n_tags"), F.size("links").alias("n_links"), _micros("updated"), _micros("expires"), "superseded_by", F.length("body").alias("body_chars"), "error")


def _source(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("source") == source).select(F.col("doc_id").alias("id"), "text")


def memory_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_points(_source(spark, sf_dir, "memory_import"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_turns(_source(spark, sf_dir, "session_log"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(windowed(event_stream(spark, f"{sf_dir}/events.parquet"), "1 hour"), ["window_start", "event_type"]).select(_micros("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(windowed(event_stream(spark, f"{sf_dir}/events.parquet"), "1 day", "6 hours"), ["window_start", "event_type"]).select(_micros("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(user_sessions(event_stream(spark, f"{sf_dir}/events.parquet")), mode="complete").select("user_id", _micros("session_start"), _micros("session_end"), "n")


def stream_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(deliveries(capture_stream(spark, f"{sf_dir}/captures.parquet")), ["source_agent", "project", "session_id", "event_id"]).withColumn("first_at", _micros("first_at"))


def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as log lines and parsed again: the turns that end with a response."""
    rows = {c: F.col(c) for c in ("project", "turns")}
    sessions, turns = parse_task_logs(task_log_lines(earliest_copy(table(spark, sf_dir, "sessions"), "session_id", rows)))
    return sessions.join(turns, "path").select("session_id", "project", F.col("id").alias("turn_id"), "turn_no", "prompt", "response")


QUERIES = {f.__name__: f for f in (log_round_trip, vault_round_trip, memory_points, transcript_lines, stream_tumbling, stream_sliding, stream_sessions, stream_captures)}
_LINES = "l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE source = '{}')"
SQL = {
    "log_round_trip": "WITH s AS (SELECT * FROM sessions WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY loaded_at) = 1), t AS (SELECT session_id, project, unnest(turns) AS t, generate_subscripts(turns, 1) AS k FROM s) SELECT session_id, coalesce(project, '') AS project, t.id AS turn_id, k AS turn_no, coalesce(t.prompt, '') AS prompt, t.response AS response FROM t WHERE trim(coalesce(t.response, ''), ' ') <> '' AND coalesce(t.id, '') <> ''",
    "vault_round_trip": f"WITH {E} SELECT id, kind, title, confidence, coalesce(len(list_filter(tags, lambda t: t IS NOT NULL)), 0)::INT AS n_tags, coalesce(len(list_filter(links, lambda t: t IS NOT NULL)), 0)::INT AS n_links, epoch_us(updated) AS updated, epoch_us(expires) AS expires, superseded_by, length(trim(body))::INT AS body_chars, NULL::VARCHAR AS error FROM e",
    "memory_points": f"""WITH {_LINES.format('memory_import')}, t AS (SELECT id, k, trim(line) AS line FROM l), h AS (SELECT *, CASE WHEN starts_with(line, '#') THEN trim(regexp_replace(line, '^#+', '')) END AS h FROM t),
g AS (SELECT *, CASE WHEN regexp_matches(h, '(?i)^task group:') OR starts_with(line, '# ') THEN trim(regexp_replace(h, '(?i)^task group:', '')) END AS g FROM h), a AS (SELECT *, CASE WHEN g IS NOT NULL THEN '' WHEN regexp_matches(h, '(?i)^task ') THEN trim(regexp_replace(h, '(?i)^task ', '')) WHEN starts_with(line, '## ') THEN '' END AS t FROM g),
x AS (SELECT *, CASE WHEN h IS NOT NULL THEN CASE WHEN g IS NOT NULL OR regexp_matches(h, '(?i)^task ') THEN '' ELSE h END END AS x FROM a),
c AS (SELECT id, k, line, h, last_value(g IGNORE NULLS) OVER w AS task_group, last_value(t IGNORE NULLS) OVER w AS task, last_value(x IGNORE NULLS) OVER w AS section, sum((starts_with(line, '- ') OR h IS NOT NULL)::INT) OVER w AS b FROM x WINDOW w AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING)),
j AS (SELECT id, task_group, task, section, bool_or(starts_with(line, '- ')) AS ok, regexp_replace(string_agg(CASE WHEN starts_with(line, '- ') THEN trim(substring(line, 3)) ELSE line END, ' ' ORDER BY k), '\\s+', ' ', 'g') AS text FROM c WHERE h IS NULL AND line <> '' AND task_group IS NOT NULL GROUP BY id, b, task_group, task, section)
SELECT DISTINCT id, task_group, task, section, CASE WHEN starts_with(lower(section), 'failure') THEN 'lesson' ELSE 'knowledge' END AS kind, text FROM j WHERE ok AND text <> '' AND task_group <> '' AND regexp_matches(lower(section), 'preference|reusable knowledge|failure|general tip|key step|lesson')""",
    "transcript_lines": f"""WITH {_LINES.format('session_log')}, s AS (SELECT *, nullif(regexp_extract(line, '^(User|Assistant): ?', 1), '') AS s FROM l), p AS (SELECT *, count(s) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS place FROM s)
SELECT id, place, max(s) AS speaker, string_agg(regexp_replace(line, '^(User|Assistant): ?', ''), chr(10) ORDER BY k) AS text FROM p WHERE place > 0 GROUP BY id, place""",
    "stream_tumbling": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS * i AS window_start, event_type, value FROM events, range(4) r(i)) SELECT epoch_us(window_start) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL",
    "stream_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 30 MINUTES) AS session_end, count(*) AS n FROM g GROUP BY user_id, g",
    "stream_captures": "SELECT lower(trim(input.source_agent)) AS source_agent, input.project AS project, input.session_id AS session_id, input.event_id AS event_id, count(*) AS n, epoch_us(min(captured_at)) AS first_at, count(DISTINCT (input.title, input.context, input.action, input.outcome)) > 1 AS conflict FROM captures GROUP BY 1, 2, 3, 4",
}
