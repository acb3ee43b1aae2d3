"""Vaults of Markdown files with YAML front matter: read, parse, render, write."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.schema import ENTRY

FOLDERS = {"pattern": "patterns", "decision": "decisions", "reflection": "reflections"}


def _utc(value) -> datetime | None:
    if value is None or value == "":
        return None
    when = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    return when.astimezone(timezone.utc).replace(tzinfo=None) if when.tzinfo else when


def parse_entry(text: str | None) -> dict:
    """The columns of ENTRY and ``error``, which is null for a sound entry."""
    import yaml

    row = dict.fromkeys([*ENTRY.names, "error"])
    head, found, body = (text or "").partition("\n---\n")
    if not head.startswith("---\n") or not found:
        return row | {"error": "no front matter"}
    try:
        meta = yaml.safe_load(head[4:])
        if not isinstance(meta, dict):
            return row | {"error": "front matter is no mapping"}
        strings = {n: None if meta.get(k) is None else str(meta[k]) for n, k in (("id", "id"), ("kind", "type"), ("title", "title"), ("status", "status"), ("superseded_by", "superseded_by"))}
        lists = {n: [str(v) for v in meta.get(n) or []] for n in ("tags", "source_agents", "supersedes", "links")}
        times = {n: _utc(meta.get(n)) for n in ("created", "updated", "last_verified", "expires")}
        row |= strings | lists | times | {"confidence": float(meta["confidence"]), "decay_rate": float(meta.get("decay_rate", 0.05)), "body": body.strip()}
    except (yaml.YAMLError, ValueError, KeyError, TypeError) as e:
        return row | {"error": f"{type(e).__name__}: {e}"[:200]}
    if not (row["id"] or "").strip() or not (row["title"] or "").strip():
        row["error"] = "id and title are required"
    return row


def parse_entries(files: DataFrame, text: str = "content", path: str = "path") -> DataFrame:
    """The entries of ``files``, with path and ``error``; a broken file gives one row with its error, not a failure."""
    schema = T.StructType([T.StructField("path", T.StringType()), *ENTRY.fields, T.StructField("error", T.StringType())])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p} | parse_entry(t) for p, t in zip(batch["path"], batch["content"])]
            out = pd.DataFrame(rows, columns=schema.names)
            for n in ("created", "updated", "last_verified", "expires"):
                out[n] = pd.to_datetime(out[n], utc=True)
            yield out

    return files.select(F.col(path).alias("path"), F.col(text).cast("string").alias("content")).mapInPandas(parse, schema)


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """All entries below ``root``, one file each, in any of the folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return parse_entries(files.select("path", F.col("content").cast("string").alias("content")))


def render_entries(entries: DataFrame) -> DataFrame:
    """path, content of each entry as a Markdown file; the folder follows the kind."""
    import yaml

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                meta = {"id": r["id"], "type": r["kind"], "title": r["title"], "status": r["status"], "confidence": r["confidence"]}
                meta |= {n: [] if r[n] is None else [str(v) for v in r[n] if v is not None] for n in ("tags", "source_agents", "supersedes", "links")}
                meta |= {n: None if pd.isna(r[n]) else pd.Timestamp(r[n]).isoformat() for n in ("created", "updated", "last_verified", "expires")}
                meta |= {"superseded_by": r["superseded_by"], "decay_rate": r["decay_rate"]}
                head = yaml.safe_dump(meta, allow_unicode=True, sort_keys=False, width=10_000)
                out.append((f"{FOLDERS.get(r['kind'], 'entries')}/{r['id']}.md", f"---\n{head}---\n\n{(r['body'] or '').strip()}\n"))
            yield pd.DataFrame(out, columns=["path", "content"])

    return entries.select(*ENTRY.names).mapInPandas(render, "path string, content string")


def write_vault(entries: DataFrame, root: str) -> None:
    """Write each entry to its file below ``root``, a folder that all executors share; each task writes its own."""

    def write(rows) -> None:
        import os
        from pathlib import Path

        for r in rows:
            to = Path(root, r["path"])
            to.parent.mkdir(parents=True, exist_ok=True)
            part = to.with_suffix(f".{os.getpid()}.part")
            part.write_text(r["content"])
            part.replace(to)  # a task that runs again leaves the same file

    render_entries(entries).foreachPartition(write)
