"""Corpus maintenance: tag vocabularies, evidence, extractive distillation, capture history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What marks a sentence as lasting, and what counts as evidence.
DURABLE = r"(?i)\b(?:decision|preference|root cause|always|never|must|because|instead|failure mode|lesson|fixed)\b"
EVIDENCE = r"\b\w+(?:/[\w.-]+)+|\b\d+(?:\.\d+)?\s?(?:%|ms|s|seconds|MiB|GB|files|rows|tokens)|\b[0-9a-f]{7,40}\b|`[^`]+`"


def tag_vocabulary(entries: DataFrame) -> DataFrame:
    """folded, n, canonical, n_spellings: tags regardless of case and padding, the commonest spelling as canonical."""
    used = entries.select("id", F.explode("tags").alias("tag")).where("tag is not null and trim(tag) <> ''").select("id", F.trim("tag").alias("tag")).distinct()
    spelled = used.groupBy(F.lower("tag").alias("folded"), "tag").agg(F.count("*").alias("n"))
    return spelled.groupBy("folded").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("_n"), "tag")).alias("_c"), F.count("*").alias("n_spellings")).select("folded", "n", F.col("_c.tag").alias("canonical"), "n_spellings")


def canonical_tags(entries: DataFrame, least_uses: int = 2, most: int = 6) -> DataFrame:
    """id, subjects: each entry's canonical subject tags that are used often enough, the ``most`` commonest."""
    vocab = tag_vocabulary(entries).where(F.col("n") >= least_uses)
    used = entries.select("id", F.explode(F.array_distinct(F.transform("tags", lambda t: F.lower(F.trim(t))))).alias("folded")).where(~F.col("folded").contains(":"))
    joined = used.join(vocab.select("folded", "canonical", "n"), "folded")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "canonical"))
    kept = joined.withColumn("_r", rank).where(F.col("_r") <= most)
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "canonical"))), lambda x: x["canonical"]).alias("subjects"))


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed, without bullets; empty ones dropped."""
    cut = F.split(F.regexp_replace(text, r"(?<=[.!?])\s+|\n+", "\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+[.)])\s+", ""))), lambda s: F.length(s) > 0)


def extracted(texts: DataFrame, most: int = 6) -> DataFrame:
    """id, n_sentences, kept, n_evidence, confidence: the first ``most`` distinct sentences of 24 to 400 characters that
    are marked as lasting or hold evidence; 0.6 with two pieces of evidence or more, else 0.5."""
    found = texts.select("id", sentences(F.col("text")).alias("_s"))
    kept = F.slice(F.array_distinct(F.filter("_s", lambda s: F.length(s).between(24, 400) & (s.rlike(DURABLE) | s.rlike(EVIDENCE)))), 1, most)
    return found.select("id", F.size("_s").alias("n_sentences"), kept.alias("kept")).withColumn("n_evidence", F.aggregate("kept", F.lit(0), lambda a, s: a + s.rlike(EVIDENCE).cast("int"))).withColumn("confidence", F.when(F.col("n_evidence") >= 2, 0.6).otherwise(0.5))


def capture_keys(captures: DataFrame) -> DataFrame:
    """source_agent, project, session_id, event_id, n_ids, n_contents: deliveries per event key; more than one content is a
    conflict, more than one id with one content a repeated delivery."""
    flat = captures.select("id", F.lower(F.trim("input.source_agent")).alias("source_agent"), "input.project", "input.session_id", "input.event_id", F.xxhash64("input.title", "input.context", "input.action", "input.outcome").alias("_h"))
    return flat.groupBy("source_agent", "project", "session_id", "event_id").agg(F.count_distinct("id").alias("n_ids"), F.count_distinct("_h").alias("n_contents"))


def latest_states(queue_items: DataFrame) -> DataFrame:
    """id, status, attempts, updated_at: the last state of each item, ties by status."""
    state = F.struct("updated_at", "status", "attempts")
    return queue_items.groupBy("id").agg(F.max(state).alias("_s")).select("id", "_s.status", "_s.attempts", "_s.updated_at")


def related_entries(captures: DataFrame, entries: DataFrame, k: int = 20) -> DataFrame:
    """capture_id, entry_id, rank: active entries with the capture's title (any case) or any of its tags, newest first.

    The either-or is a union of two equi-joins; of an entry tag only the ``k`` newest entries can be among a capture's first
    ``k``, so each tag is cut to those before the join, and a popular tag costs ``k`` rows per capture.
    """
    active = entries.where(F.col("status") == "active").select(F.col("id").alias("entry_id"), F.lower("title").alias("_title"), F.array_distinct("tags").alias("_tags"), "updated")

    def newest(rows: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.desc("updated"), "entry_id")
        return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")

    by_title = newest(active.select("entry_id", "updated", F.col("_title").alias("_k")), "_k")
    by_tag = newest(active.select("entry_id", "updated", F.explode("_tags").alias("_k")), "_k")
    asked = captures.select(F.col("id").alias("capture_id"), F.lower("input.title").alias("_k"))
    tagged = captures.select(F.col("id").alias("capture_id"), F.explode(F.array_distinct("input.tags")).alias("_k"))
    found = asked.join(by_title, "_k").select("capture_id", "entry_id", "updated").unionByName(tagged.join(by_tag, "_k").select("capture_id", "entry_id", "updated")).distinct()
    order = Window.partitionBy("capture_id").orderBy(F.desc("updated"), "entry_id")
    return found.select("capture_id", "entry_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def session_states(sessions: DataFrame, captures: DataFrame) -> DataFrame:
    """session_id, state: recorded with a capture of the session, then forked, written, empty, incomplete, available."""
    seen = captures.select(F.col("input.session_id").alias("session_id")).where("session_id is not null").distinct().withColumn("_c", F.lit(True))
    turns = F.coalesce(F.size("turns"), F.lit(0))
    state = F.when(F.col("_c"), "captured").when(F.col("forked"), "forked").when(turns <= 0, "empty").when(F.col("incomplete"), "incomplete").otherwise("available")
    return sessions.join(seen, "session_id", "left").select("session_id", state.alias("state"))
