"""Vault files, session logs and notes."""

import json
from datetime import datetime

from lorespark.config import GraphConfig, relation_kinds
from lorespark.schema import ENTRY
from lorespark.sources import logs, vault


def test_vault_is_written_and_read(spark, tmp_path):
    t = datetime(2025, 3, 1, 12, 0, 0, 250000)
    rows = [("m-1", "decision", "A: title — “x”", "active", 0.5, ["a", "b: c"], None, t, t, t, None, [], None, ["m-2"], 0.05, "body\n---\nmore"), ("m-2", "lesson", "2024-01-01", "fading", 1.0, [], ["x"], t, t, t, t, ["m-1"], "m-1", [], 0.1, "  padded  ")]
    vault.write_vault(spark.createDataFrame(rows, ENTRY), str(tmp_path))
    (tmp_path / "broken.md").write_text("no front matter")
    read = {r["id"]: r for r in vault.read_vault(spark, str(tmp_path)).collect()}
    assert read["m-1"]["title"] == rows[0][2] and read["m-1"]["body"] == "body\n---\nmore" and read["m-1"]["updated"] == t and read["m-1"]["tags"] == ["a", "b: c"] and read["m-1"]["error"] is None
    assert read["m-2"]["superseded_by"] == "m-1" and read["m-2"]["body"] == "padded" and read["m-2"]["expires"] == t and "decisions" in read["m-1"]["path"]
    assert read[None]["error"] == "no front matter"


def lines(spark, rows):
    return spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(rows)], "path string, place int, line string")


def event(sub, **more):
    return {"type": "event_msg", "payload": {"type": sub, **more}}


def item(role, text, **more):
    return {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "output_text", "text": text}, {"type": "image"}], **more}}


def test_task_logs(spark):
    rows = [{"type": "session_meta", "payload": {"id": "s1", "cwd": "/w"}}, event("task_started", turn_id="t1"), event("user_message", message="hello"), item("assistant", "draft", phase="commentary"), item("assistant", "done", phase="final_answer"), event("task_complete", turn_id="t1"),
            event("task_started", turn_id="t2"), event("user_message", message="stop"), event("turn_aborted"), event("task_started", turn_id="t3"), item("user", "again"), event("task_complete", last_agent_message="ok")]
    sessions, turns = logs.parse_task_logs(lines(spark, rows))
    assert [tuple(r) for r in sessions.collect()] == [("f", "s1", "/w", False)]
    assert {(r["id"], r["prompt"], r["response"]) for r in turns.collect()} == {("t1", "hello", "done"), ("t3", "again", "ok")}


def test_turn_logs(spark):
    rows = [{"type": "session", "id": "s2", "cwd": "/w"}, {"type": "turn/start", "data": {"turn": 1}}, {"type": "user/message", "data": {"source": {"kind": "user"}, "content": "ask"}}, {"type": "assistant/message", "data": {"turn": 1, "message": {"content": [{"type": "text", "text": "reply"}]}}}, {"type": "turn/end", "data": {"turn": 1, "reason": {"kind": "completed"}}},
            {"type": "turn/start", "data": {"turn": 2}}, {"type": "turn/end", "data": {"turn": 2, "reason": {"kind": "completed"}}}]
    sessions, turns = logs.parse_turn_logs(lines(spark, rows))
    assert sessions.first()["session_id"] == "s2"
    assert [(r["id"], r["prompt"], r["response"]) for r in turns.collect()] == [("1", "ask", "reply")]


def test_note_points(spark):
    text = "# Task Group: g\n## Task 1: t\n### Reusable knowledge\n- one\n  wrapped\n- one wrapped\n### keywords\n- no\n## User preferences\n- two\n# Other\n### Failures\n- three"
    got = {tuple(r)[1:] for r in logs.note_points(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).collect()}
    assert got == {("g", "1: t", "Reusable knowledge", "knowledge", "one wrapped"), ("g", "", "User preferences", "knowledge", "two"), ("Other", "", "Failures", "lesson", "three")}


def test_settings():
    assert GraphConfig().validate() and relation_kinds(" tag,link,tag ") == ["tag", "link"]
    for bad in (lambda: GraphConfig(dimensions=1).validate(), lambda: relation_kinds("tag,x")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("a value out of range must be refused")
