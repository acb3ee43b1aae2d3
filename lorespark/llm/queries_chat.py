"""Queries on chat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.conversations import conversation_rows, conversations, kept_turns, link_agreement, link_trees, loose_rows, message_rows, reply_links
from lorespark.llm.staging import staged
from lorespark.session import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_turns(staged(message_rows(table(spark, sf_dir, "messages"))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every session that can be rebuilt whole."""
    return _turns(spark, sf_dir).select("session_id", "turn_id", "prompt_message_id", "response_message_id")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt sessions: turns in order with prompt and response."""
    return conversations(table(spark, sf_dir, "messages"), _turns(spark, sf_dir))


def p5_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of sessions that p5_found leaves out as rows lack a turn_id, and that links to the other rows make whole."""
    messages = table(spark, sf_dir, "messages")
    rows = staged(loose_rows(messages, staged(message_rows(messages))))
    return kept_turns(rows, link_trees(reply_links(rows))).select("session_id", "turn_id", "prompt_message_id", "response_message_id")


def p5_link_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links found with the recorded turns hidden, measured against them."""
    return link_agreement(staged(conversation_rows(table(spark, sf_dir, "messages"))))


_FOUND = r"""
WITH once AS (SELECT * FROM messages WHERE message_id IS NOT NULL AND session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY loaded_at) = 1),
r AS (SELECT *, CASE lower(trim(speaker)) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'ai' THEN 'assistant' ELSE 'other' END AS role,
  count(seq) OVER (PARTITION BY session_id) > 0 AS has_seq, coalesce(regexp_replace(text, '\s+', '', 'g'), '') <> '' AS said FROM once),
p AS (SELECT *, CASE WHEN has_seq THEN seq ELSE epoch_us(sent_at) END AS pos FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos, sent_at, message_id) AS place FROM p),
t AS (SELECT session_id, turn_id, max(CASE WHEN role = 'user' AND said THEN place END) AS pp, max(CASE WHEN role = 'assistant' AND said AND coalesce(phase, '') <> 'commentary' THEN place END) AS rp FROM o WHERE turn_id IS NOT NULL GROUP BY ALL HAVING bool_or(role IN ('user', 'assistant'))),
bad AS (SELECT session_id FROM t WHERE pp IS NULL OR rp IS NULL OR rp < pp
  UNION SELECT session_id FROM o WHERE has_seq AND turn_id IS NOT NULL GROUP BY session_id, turn_id HAVING max(seq) - min(seq) + 1 <> count(*)
  UNION SELECT session_id FROM o WHERE turn_id IS NULL AND role IN ('user', 'assistant')
  UNION SELECT session_id FROM o WHERE has_seq GROUP BY session_id, seq HAVING count(*) > 1)
"""

QUERIES = {"p5_found": p5_found, "p5_turns": p5_turns, "p5_linked": p5_linked, "p5_link_quality": p5_link_quality}
SQL = {
    "p5_found": f"""{_FOUND} SELECT t.session_id, t.turn_id, a.message_id AS prompt_message_id, b.message_id AS response_message_id
FROM t JOIN o a ON a.session_id = t.session_id AND a.place = t.pp JOIN o b ON b.session_id = t.session_id AND b.place = t.rp WHERE t.session_id NOT IN (SELECT session_id FROM bad)""",
    "p5_turns": f"""{_FOUND} SELECT t.session_id, row_number() OVER (PARTITION BY t.session_id ORDER BY t.pp) AS turn_no, t.turn_id, a.text AS prompt, b.text AS response
FROM t JOIN o a ON a.session_id = t.session_id AND a.place = t.pp JOIN o b ON b.session_id = t.session_id AND b.place = t.rp WHERE t.session_id NOT IN (SELECT session_id FROM bad)""",
}
