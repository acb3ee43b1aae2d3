"""Maintenance of a vault: imports, patches, versions, differences, fingerprints, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import excerpt
from lorespark.operators.curate import EVIDENCE
from lorespark.operators.orphans import trimmed


def import_plan(drafts: DataFrame, entries: DataFrame) -> DataFrame:
    """draft_id, entry_id, outcome: what importing a draft would do by its title (any case): create, update, unchanged, or
    invalid for a blank title or content. Of entries with one title the smallest id counts.

    ``drafts``: draft_id, title, content, kind, confidence; ``entries``: id, title, kind, confidence.
    """
    key = F.lower(F.trim("title"))
    held = entries.groupBy(key.alias("_k")).agg(F.min(F.struct("id", "kind", "confidence")).alias("_e"))
    blank = (F.coalesce(F.trim("title"), F.lit("")) == "") | (F.coalesce(F.trim("content"), F.lit("")) == "")
    joined = drafts.withColumn("_k", key).join(held, "_k", "left")
    same = F.col("kind").eqNullSafe(F.col("_e.kind")) & F.col("confidence").eqNullSafe(F.col("_e.confidence"))
    outcome = F.when(blank, "invalid").when(F.col("_e").isNull(), "create").when(same, "unchanged").otherwise("update")
    return joined.select("draft_id", F.col("_e.id").alias("entry_id"), outcome.alias("outcome"))


def patched(entries: DataFrame, patches: DataFrame) -> DataFrame:
    """``entries`` with the last patch of each applied: columns that a patch leaves null stay.

    ``patches``: id, at and some of the entries' columns; a new confidence also renews last_verified.
    """
    columns = [c for c in patches.columns if c in entries.columns and c != "id"]
    last = patches.groupBy("id").agg(F.max(F.struct("at", *columns)).alias("_p"))
    joined = entries.join(last, "id", "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.col("_p")[c], F.col(c)))
    if "last_verified" in entries.columns and "confidence" in columns:
        joined = joined.withColumn("last_verified", F.when(F.col("_p.confidence").isNotNull(), F.col("_p.at")).otherwise(F.col("last_verified")))
    return joined.drop("_p")


def created(drafts: DataFrame, now: Column, prefix: str = "mem") -> DataFrame:
    """New entries of drafts (title, content, kind, tags, confidence, source_agent): active, verified now, with the id
    ``prefix-yyyyMMdd-6 hex digits`` (of the title, content and time, so that a repeated run makes the same ids), a body
    that begins with the title as heading, and a path in the folder of the kind.

    Drafts whose title or content is blank make no entry; a null confidence means 0.5. Equal drafts make one entry, and
    further drafts that meet with one id get 12 digits.
    """
    usable = drafts.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    day = F.date_format(now, "yyyyMMdd")
    digits = F.sha2(F.concat_ws("\x1f", "title", "content", day), 256)
    once = usable.withColumn("_h", digits).dropDuplicates(["_h"])
    order = F.row_number().over(Window.partitionBy(F.substring("_h", 1, 6)).orderBy("_h"))
    id_ = F.concat(F.lit(prefix), F.lit("-"), day, F.lit("-"), F.substring("_h", F.lit(1), F.when(F.col("_n") > 1, 12).otherwise(6)))
    none = F.array().cast("array<string>")
    return once.withColumn("_n", order).withColumn("_id", id_).select(
        F.col("_id").alias("id"), "kind", "title", F.lit("active").alias("status"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("tags", none).alias("tags"),
        F.filter(F.array("source_agent"), lambda a: a.isNotNull()).alias("source_agents"), now.alias("created"), now.alias("updated"), now.alias("last_verified"), F.lit(None).cast("timestamp").alias("expires"),
        none.alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"), none.alias("links"), F.lit(0.05).alias("decay_rate"),
        F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("content")).alias("body"), F.concat("kind", F.lit("/"), "_id", F.lit(".md")).alias("path"),
    )


def superseded(entries: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """``entries`` after each of ``pairs`` (old_id, new_id): the old one is superseded by the new, the new one names and links
    the old, each once; both are updated now.

    Pairs whose ids are null, equal or not both there change nothing. Of several new ids of one old the smallest counts.
    """
    known = entries.select("id").distinct()
    asked = pairs.where("old_id is not null and new_id is not null and old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    sound = asked.join(known.withColumnRenamed("id", "old_id"), "old_id", "left_semi").join(known.withColumnRenamed("id", "new_id"), "new_id", "left_semi")
    by_old = sound.select(F.col("old_id").alias("id"), F.col("new_id").alias("_new"))
    by_new = sound.groupBy(F.col("new_id").alias("id")).agg(F.array_sort(F.collect_set("old_id")).alias("_olds"))
    none = F.array().cast("array<string>")
    added = lambda c: F.array_union(F.coalesce(c, none), F.coalesce("_olds", none))
    joined = entries.join(by_old, "id", "left").join(by_new, "id", "left")
    changed = F.col("_new").isNotNull() | F.col("_olds").isNotNull()
    return joined.select(
        *[
            {
                "status": F.when(F.col("_new").isNotNull(), F.lit("superseded")).otherwise(F.col("status")),
                "superseded_by": F.coalesce("_new", "superseded_by"),
                "supersedes": F.when(F.col("_olds").isNotNull(), added("supersedes")).otherwise(F.col("supersedes")),
                "links": F.when(F.col("_olds").isNotNull(), added("links")).otherwise(F.col("links")),
                "updated": F.when(changed, now).otherwise(F.col("updated")),
            }.get(c, F.col(c)).alias(c)
            for c in entries.columns
        ]
    )


def versions(entries: DataFrame) -> DataFrame:
    """old_id, new_id, said_by_old, said_by_new: pairs of versions as either side declares them."""
    by_new = entries.select(F.explode(F.transform("supersedes", trimmed)).alias("old_id"), F.col("id").alias("new_id")).where("old_id is not null").distinct().withColumn("_new", F.lit(True))
    by_old = entries.select(F.col("id").alias("old_id"), trimmed(F.col("superseded_by")).alias("new_id")).where("new_id is not null").distinct().withColumn("_old", F.lit(True))
    return by_new.join(by_old, ["old_id", "new_id"], "full_outer").select("old_id", "new_id", F.coalesce("_old", F.lit(False)).alias("said_by_old"), F.coalesce("_new", F.lit(False)).alias("said_by_new"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, repeats counted, with ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """n, mark: a fingerprint of a bag of rows that needs no order: the sum of their 60-bit hashes modulo 2 ** 60, so each
    task sends one number and repeated rows count."""
    parts = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    row = F.conv(F.substring(F.sha2(parts, 256), 1, 15), 16, 10).cast("bigint")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")) % F.lit(1 << 60), F.lit(0)).cast("bigint").alias("mark"))


def looked_up(lists: DataFrame, entries: DataFrame, most: int = 10) -> DataFrame:
    """id, place, entry_id, title, body: the first ``most`` entries that each list names, in the list's order, cut to 256 and
    2000 characters. ``lists``: id, ids."""
    named = lists.select("id", F.posexplode(F.slice("ids", 1, most)).alias("place", "entry_id"))
    return named.join(entries.select(F.col("id").alias("entry_id"), F.left("title", F.lit(256)).alias("title"), F.left("body", F.lit(2000)).alias("body")), "entry_id").select("id", "place", "entry_id", "title", "body")


def reviewed(entries: DataFrame) -> DataFrame:
    """id, has_evidence, proposed_confidence, placeholder: 0.65 with evidence in the body, else 0.5; a placeholder has a body
    under 120 characters and no tags."""
    evidence = F.coalesce(F.col("body").rlike(EVIDENCE), F.lit(False))
    bare = (F.length(F.trim(F.coalesce("body", F.lit("")))) < 120) & (F.coalesce(F.size("tags"), F.lit(0)) <= 0)
    return entries.select("id", evidence.alias("has_evidence"), F.when(evidence, 0.65).otherwise(0.5).alias("proposed_confidence"), bare.alias("placeholder"))


def snippet(text: Column, terms: list[str], width: int = 18) -> Column:
    """The ``width`` words around the first that begins with a term, matches in square brackets; null without one."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    marked = F.transform(w, lambda x: F.struct(x.alias("x"), F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.lower(x).startswith(t)).alias("m")))

    def cut(m: Column) -> Column:
        first = F.array_position(F.transform(m, lambda x: x["m"]), True)
        start = F.greatest(F.lit(1), first.cast("int") - width // 2)
        shown = F.transform(F.slice(m, start, width), lambda x: F.when(x["m"], F.concat(F.lit("["), x["x"], F.lit("]"))).otherwise(x["x"]))
        out = F.concat(F.when(start > 1, "… ").otherwise(""), F.array_join(shown, " "), F.when(start + width <= F.size(m), " …").otherwise(""))
        return F.when(first > 0, out)

    return F.transform(F.array(marked), cut)[0]


def prompt_context(hits: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """id, title, excerpt of the first active entries among ranked hits (id, rank)."""
    active = entries.where(F.col("status") == "active").select("id", F.left("title", F.lit(160)).alias("title"), excerpt(F.col("body"), 600).alias("excerpt"))
    return active.join(F.broadcast(hits), "id").orderBy("rank").limit(most).select("id", "title", "excerpt")  # a short list
