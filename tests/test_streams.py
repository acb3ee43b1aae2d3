"""Streams: late rows, updates by key, packed logs."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorespark.sources import logs
from lorespark.streaming.windows import event_stream, run_available, user_sessions, windowed

T0 = datetime(2025, 1, 1)


def write(spark, folder, name, rows):
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, "view", 1.0) for i, m, u in rows], "event_id int, ts timestamp, user_id int, event_type string, value double")
    df.coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    import pathlib
    import shutil

    part = next(pathlib.Path(f"{folder}/tmp-{name}").glob("part-*"))
    pathlib.Path(f"{folder}/events").mkdir(exist_ok=True)
    shutil.move(str(part), f"{folder}/events/{name}.parquet")
    import os

    at = 1_700_000_000 + int(name)
    os.utime(f"{folder}/events/{name}.parquet", (at, at))


def test_late_rows_are_dropped_and_windows_updated_by_key(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, "1", [(1, 0, 1), (2, 10, 1), (3, 300, 2)])
    write(spark, folder, "2", [(4, 310, 2)])
    write(spark, folder, "3", [(5, 5, 1), (6, 305, 1), (7, 900, 1)])  # minute 5 is behind the watermark
    stream = windowed(event_stream(spark, f"{folder}/events", 1), "1 hour")
    got = {(r["window_start"], r["n"]) for r in run_available(stream, ["window_start", "event_type"]).collect()}
    assert got == {(T0, 2), (T0 + timedelta(hours=5), 3), (T0 + timedelta(hours=15), 1)}
    final = run_available(windowed(event_stream(spark, f"{folder}/events", 1), "1 hour")).collect()
    assert {(r["window_start"], r["n"]) for r in final} == {(T0, 2), (T0 + timedelta(hours=5), 3)}  # the last window is still open
    sessions = run_available(user_sessions(event_stream(spark, f"{folder}/events", 1)), mode="complete").collect()
    assert {(r["user_id"], r["n"]) for r in sessions} >= {(2, 2)}


def test_packed_logs_are_read(spark, tmp_path):
    import zstandard

    lines = [{"type": "session_meta", "payload": {"id": "s", "cwd": "/w"}}, {"type": "event_msg", "payload": {"type": "task_started", "turn_id": "t"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "über"}}, {"type": "event_msg", "payload": {"type": "task_complete", "turn_id": "t", "last_agent_message": "r" * 30_000}}]
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(map(json.dumps, lines)).encode()))
    sessions, turns = logs.parse_task_logs(logs.read_lines(spark, str(tmp_path), "*.jsonl.zst"))
    row = sessions.join(turns, "path").first()
    assert (row["session_id"], row["id"], row["prompt"], len(row["response"])) == ("s", "t", "über", 30_000)
    assert logs.shortened(turns).select(F.length("response")).first()[0] == 24_000
