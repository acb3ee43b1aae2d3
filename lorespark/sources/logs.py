"""Session logs in JSON lines and notes in Markdown, parsed with windows over their lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headings of sections that hold reusable notes.
NOTE_SECTIONS = ["preference", "reusable knowledge", "failure", "general tip", "key step", "lesson"]


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, place, line of the files below ``root``; a file is one value, split where it is read. Files that end in .zst are
    decompressed first."""
    if pattern.endswith(".zst"):
        packed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        files = packed.select("path", _unzstd("content").alias("value"))
    else:
        files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n")).alias("place", "line")).where("trim(line) <> ''")


@F.pandas_udf(T.StringType())
def _unzstd(content: pd.Series) -> pd.Series:
    import zstandard

    return content.map(lambda b: None if b is None else zstandard.ZstdDecompressor().stream_reader(b, read_across_frames=True).read().decode("utf-8", "replace"))


def task_log_lines(sessions: DataFrame) -> DataFrame:
    """path, place, line: sessions (session_id, project, turns) as logs that :func:`parse_task_logs` reads, one path each."""
    event = lambda sub, **more: F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit(sub).alias("type"), *[v.alias(n) for n, v in more.items()]).alias("payload")))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("session_id").alias("id"), F.col("project").alias("cwd")).alias("payload")))
    of_turn = lambda t: F.array(event("task_started", turn_id=t["id"]), event("user_message", message=t["prompt"]), event("task_complete", turn_id=t["id"], last_agent_message=t["response"]))
    rows = F.concat(F.array(meta), F.flatten(F.transform(F.coalesce("turns", F.array().cast(sessions.schema["turns"].dataType)), of_turn)))
    return sessions.select(F.concat(F.col("session_id"), F.lit(".jsonl")).alias("path"), F.posexplode(rows).alias("place", "line"))


def _get(column: str, path: str) -> Column:
    return F.coalesce(F.get_json_object(column, path), F.lit(""))


def _content(column: str, path: str) -> Column:
    """The text blocks of a message, joined by line breaks; a plain string as it is."""
    blocks = F.from_json(F.get_json_object(column, path), "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: b["text"])
    return F.coalesce(F.array_join(texts, "\n"), F.get_json_object(column, path), F.lit(""))


def shortened(turns: DataFrame, prompt_chars: int = 8_000, response_chars: int = 24_000) -> DataFrame:
    """``turns`` with prompts and responses cut to so many characters, for prompts to a model."""
    return turns.withColumn("prompt", F.left("prompt", F.lit(prompt_chars))).withColumn("response", F.left("response", F.lit(response_chars)))


def _turns(events: DataFrame) -> DataFrame:
    """path, turn_no, id, prompt, response (whole) from events with started, turn, prompt, response, done columns (null or
    value).

    A turn reaches from one start to the next; it counts once it ends with a response.
    """
    order = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("turn_no", F.count("started").over(order)).where("turn_no > 0")
    per = numbered.groupBy("path", "turn_no").agg(
        F.max_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("place"))).alias("prompt"),
        F.max_by("response", F.when(F.col("response").isNotNull(), F.col("place"))).alias("response"),
        F.coalesce(F.max(F.nullif("started", F.lit(""))), F.max("ended_turn")).alias("id"),
        F.max("done").alias("done"),
    )
    whole = (F.col("done") == "completed") & (F.trim(F.coalesce("response", F.lit(""))) != "") & (F.coalesce("id", F.lit("")) != "")
    return per.where(whole).select("path", "turn_no", "id", F.coalesce("prompt", F.lit("")).alias("prompt"), "response")


def parse_task_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns of logs with session_meta, event_msg and response_item lines."""
    e = lines.select("path", "place", "line", _get("line", "$.type").alias("kind"), _get("line", "$.payload.type").alias("sub"))
    message, item = F.col("kind") == "event_msg", (F.col("kind") == "response_item") & (F.col("sub") == "message")
    role, phase = _get("line", "$.payload.role"), _get("line", "$.payload.phase")
    final = F.when(_get("line", "$.payload.last_agent_message") != "", _get("line", "$.payload.last_agent_message"))
    events = e.select(
        "path",
        "place",
        F.when(message & (F.col("sub") == "task_started"), _get("line", "$.payload.turn_id")).alias("started"),
        F.when(message & (F.col("sub") == "task_complete"), F.nullif(_get("line", "$.payload.turn_id"), F.lit(""))).alias("ended_turn"),
        F.when(message & (F.col("sub") == "user_message"), _get("line", "$.payload.message")).when(item & (role == "user"), _content("line", "$.payload.content")).alias("prompt"),
        F.when(message & (F.col("sub") == "task_complete"), final).when(item & (role == "assistant") & phase.isin("final_answer", "final"), _content("line", "$.payload.content")).alias("response"),
        F.when(message & (F.col("sub") == "task_complete"), "completed").when(message & (F.col("sub") == "turn_aborted"), "aborted").alias("done"),
    )
    meta = e.where("kind = 'session_meta'").groupBy("path").agg(F.min_by("line", "place").alias("line"))
    sessions = meta.select("path", F.coalesce(F.nullif(_get("line", "$.payload.id"), F.lit("")), _get("line", "$.payload.session_id")).alias("session_id"), _get("line", "$.payload.cwd").alias("project"), F.get_json_object("line", "$.payload.parent_thread_id").isNotNull().alias("forked"))
    return sessions, _turns(events)


def parse_turn_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns of logs with session, turn/start, user/message, assistant/message and turn/end lines."""
    e = lines.select("path", "place", "line", _get("line", "$.type").alias("kind"))
    interrupted = _get("line", "$.data.interrupted") == "true"
    events = e.select(
        "path",
        "place",
        F.when(F.col("kind") == "turn/start", _get("line", "$.data.turn")).alias("started"),
        F.lit(None).cast("string").alias("ended_turn"),
        F.when((F.col("kind") == "user/message") & (_get("line", "$.data.source.kind") != "plugin"), _content("line", "$.data.content")).alias("prompt"),
        F.when((F.col("kind") == "assistant/message") & ~interrupted, _content("line", "$.data.message.content")).alias("response"),
        F.when((F.col("kind") == "turn/end") & (_get("line", "$.data.reason.kind") == "completed"), "completed").alias("done"),
    )
    meta = e.where("kind = 'session'").groupBy("path").agg(F.min_by("line", "place").alias("line"))
    return meta.select("path", _get("line", "$.id").alias("session_id"), _get("line", "$.cwd").alias("project"), F.lit(False).alias("forked")), _turns(events)


def newest_sessions(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """One row per session id: of the file written last (``files``: path, modified), ties by path."""
    order = Window.partitionBy("session_id").orderBy(F.desc("modified"), "path")
    dated = sessions.where("session_id <> '' and project <> ''").join(files.select("path", "modified"), "path")
    return dated.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def note_points(notes: DataFrame) -> DataFrame:
    """id, task_group, task, section, kind, text: the bullets of reusable sections of Markdown notes (id, text).

    Headings carry on to the lines below them: a first heading names the task group, ``Task ...`` a task, others a section.
    Wrapped bullets are joined, repeated ones of the same place count once.
    """
    lines = notes.select("id", F.posexplode(F.split("text", "\n")).alias("place", "raw")).select("id", "place", F.trim("raw").alias("line"))
    heading = F.when(F.col("line").startswith("#"), F.trim(F.regexp_replace("line", "^#+", "")))
    marked = lines.withColumn("_h", heading).withColumn("_g", F.when(F.col("_h").rlike("(?i)^task group:") | F.col("line").startswith("# "), F.trim(F.regexp_replace("_h", "(?i)^task group:", ""))))
    marked = marked.withColumn("_t", F.when(F.col("_g").isNotNull(), "").when(F.col("_h").rlike("(?i)^task "), F.trim(F.regexp_replace("_h", "(?i)^task ", ""))).when(F.col("line").startswith("## "), ""))
    names = F.col("_g").isNotNull() | F.col("_h").rlike("(?i)^task ")
    marked = marked.withColumn("_x", F.when(F.col("_h").isNotNull(), F.when(names, "").otherwise(F.col("_h"))))
    down = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.select("id", "place", "line", "_h", *[F.last(c, ignorenulls=True).over(down).alias(n) for c, n in (("_g", "task_group"), ("_t", "task"), ("_x", "section"))])
    starts = F.col("line").startswith("- ") | F.col("_h").isNotNull()
    pieces = carried.withColumn("_b", F.sum(starts.cast("int")).over(down))
    bullet = F.when(F.col("line").startswith("- "), F.trim(F.substring("line", 3, 1 << 30))).otherwise(F.col("line"))
    joined = pieces.where("_h is null and line <> '' and task_group is not null").groupBy("id", "_b", "task_group", "task", "section").agg(F.min("place").alias("_p"), F.max(F.col("line").startswith("- ")).alias("_is"), F.array_sort(F.collect_list(F.struct("place", bullet.alias("t")))).alias("_l"))
    text = F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["t"]), " "), r"\s+", " ")
    section = F.lower("section")
    kept = joined.where(F.col("_is") & F.exists(F.array(*[F.lit(s) for s in NOTE_SECTIONS]), lambda s: section.contains(s)))
    points = kept.select("id", "task_group", "task", "section", F.when(section.startswith("failure"), "lesson").otherwise("knowledge").alias("kind"), text.alias("text"))
    return points.where("text <> '' and task_group <> ''").distinct()


def transcript_turns(documents: DataFrame) -> DataFrame:
    """id, place, speaker, text of transcripts with ``User:`` and ``Assistant:`` lines; other lines go on with the turn."""
    lines = documents.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    speaker = F.regexp_extract("line", "^(User|Assistant): ?", 1)
    down = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    turned = lines.withColumn("_s", F.nullif(speaker, F.lit(""))).withColumn("place", F.count("_s").over(down)).where("place > 0")
    said = F.regexp_replace("line", "^(User|Assistant): ?", "")
    return turned.groupBy("id", "place").agg(F.max("_s").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
