"""Claims that texts state: direction and strength, contradictions and recurring subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import NEGATIVE_MARKERS, POSITIVE_MARKERS, marker_count, subject_tags

#: Margin between the directions from which a text states a claim.
LEAST_STRENGTH = 2
#: Entries of one side of a subject that meet the other side at a time.
BLOCK_SIDE = 5_000
#: Statuses that take no part in claims and patterns.
RETIRED = ["superseded", "archived"]


def claims(texts: DataFrame) -> DataFrame:
    """``texts`` (any columns and ``text``) with positive, negative, net, strength and decisive instead of the text."""
    counted = texts.withColumn("positive", marker_count(F.col("text"), POSITIVE_MARKERS)).withColumn("negative", marker_count(F.col("text"), NEGATIVE_MARKERS)).drop("text")
    return counted.withColumn("net", F.signum(F.col("positive") - F.col("negative")).cast("int")).withColumn("strength", F.abs(F.col("positive") - F.col("negative"))).withColumn("decisive", (F.col("net") != 0) & (F.col("strength") >= LEAST_STRENGTH))


def stated(entries: DataFrame) -> DataFrame:
    """id, subject, net of entries in use that state a claim: one row per subject tag."""
    used = entries.where(~F.col("status").isin(RETIRED)).select("id", subject_tags(F.col("tags")).alias("subjects"), F.concat_ws(" ", "title", "body").alias("text"))
    return claims(used.where(F.size("subjects") > 0)).where("decisive").select("id", F.explode("subjects").alias("subject"), "net")


def firm(entries: DataFrame, least_strength: int = LEAST_STRENGTH) -> DataFrame:
    """id, tag, net of the entries of any status that state a claim: one row per tag, scopes too."""
    texts = entries.where(F.size("tags") > 0).select("id", F.array_distinct(F.filter("tags", lambda t: t.isNotNull())).alias("tags"), F.concat_ws(" ", "title", "body").alias("text"))
    return claims(texts).where((F.col("net") != 0) & (F.col("strength") >= least_strength)).select("id", F.explode("tags").alias("tag"), "net")


def contradictions(entries: DataFrame) -> DataFrame:
    """subject, id_a, id_b, net_a, net_b (id_a < id_b): entries in use that share a subject and state opposite claims.

    Entries without a firm claim are dropped before the join, and only opposite sides of a subject meet. The negative side of
    a subject is cut into blocks of about ``BLOCK_SIDE`` entries, and the positive ones go to each. The pairs are the
    result; :func:`disputed_subjects` counts the sides without pairing them.
    """
    firm = stated(entries)
    sizes = firm.groupBy("subject").agg(F.count_if(F.col("net") < 0).alias("_k"), F.count_if(F.col("net") > 0).alias("_m")).where("_k > 0 and _m > 0")
    blocks = sizes.select("subject", F.ceil(F.col("_k") / BLOCK_SIDE).alias("_blocks"))
    placed = firm.join(blocks, "subject")
    positive = placed.where("net > 0").select("subject", F.col("id").alias("_p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"))
    negative = placed.where("net < 0").select("subject", F.col("id").alias("_n"), F.pmod(F.xxhash64("id"), F.col("_blocks")).alias("_block"))
    first = F.col("_p") < F.col("_n")
    return positive.join(negative, ["subject", "_block"]).select(
        "subject", F.least("_p", "_n").alias("id_a"), F.greatest("_p", "_n").alias("id_b"), F.when(first, 1).otherwise(-1).alias("net_a"), F.when(first, -1).otherwise(1).alias("net_b")
    )


def disputed_subjects(entries: DataFrame) -> DataFrame:
    """subject, n_positive, n_negative and one example of each side, for subjects that have both."""
    sides = stated(entries).groupBy("subject").agg(F.count_if(F.col("net") > 0).alias("n_positive"), F.count_if(F.col("net") < 0).alias("n_negative"), F.min(F.when(F.col("net") > 0, F.col("id"))).alias("positive_id"), F.min(F.when(F.col("net") < 0, F.col("id"))).alias("negative_id"))
    return sides.where("n_positive > 0 and n_negative > 0")


def patterns(entries: DataFrame, least_members: int = 3, examples: int = 5) -> DataFrame:
    """subject, n_members, first_titles: subjects that entries in use share, with the first titles in order.

    A subject may have any number of members; only ``examples`` titles of each are kept, by a ranked window. All of them
    are rows of :func:`pattern_members`.
    """
    used = entries.where(~F.col("status").isin(RETIRED)).select("id", "title", F.explode(subject_tags(F.col("tags"))).alias("subject"))
    sized = used.groupBy("subject").agg(F.count("*").alias("n_members")).where(F.col("n_members") >= least_members)
    rank = F.row_number().over(Window.partitionBy("subject").orderBy("title", "id"))
    shown = used.withColumn("_r", rank).where(F.col("_r") <= examples).groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("first_titles"))
    return sized.join(shown, "subject")


def pattern_members(entries: DataFrame, least_members: int = 3) -> DataFrame:
    """subject, id, title, rank: every member of each pattern (see :func:`patterns`), in the order of titles and ids."""
    used = entries.where(~F.col("status").isin(RETIRED)).select("id", "title", F.explode(subject_tags(F.col("tags"))).alias("subject"))
    shared = used.groupBy("subject").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_members).select("subject")
    return used.join(shared, "subject").select("subject", "id", "title", F.row_number().over(Window.partitionBy("subject").orderBy("title", "id")).alias("rank"))


def reflection(entries: DataFrame, period: Column) -> DataFrame:
    """period, n_entries, n_disputed, n_patterns: what a periodic reflection would report on."""
    dated = entries.withColumn("_period", period)
    disputed = stated(entries).groupBy("subject").agg(F.count_if(F.col("net") > 0).alias("p"), F.count_if(F.col("net") < 0).alias("n")).where("p > 0 and n > 0").select("subject")
    tagged = dated.where(~F.col("status").isin(RETIRED)).select("_period", "id", F.explode(subject_tags(F.col("tags"))).alias("subject"))
    subjects = tagged.join(disputed.withColumn("_d", F.lit(1)), "subject", "left").groupBy("_period", "subject").agg(F.count("*").alias("n"), F.max("_d").alias("_d"))
    per = subjects.groupBy("_period").agg(F.count_if(F.col("_d") == 1).alias("n_disputed"), F.count_if(F.col("n") >= 2).alias("n_patterns"))
    counted = dated.groupBy("_period").agg(F.count("*").alias("n_entries"))
    return counted.join(per, "_period", "left").select(F.col("_period").alias("period"), "n_entries", F.coalesce("n_disputed", F.lit(0)).alias("n_disputed"), F.coalesce("n_patterns", F.lit(0)).alias("n_patterns"))
