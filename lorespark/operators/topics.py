"""Topic projection: entries grouped by announced subject, dominant tag or kind, with keywords and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import title_subject, title_tokens


def topic_of_entries(entries: DataFrame) -> DataFrame:
    """id, topic, basis: the subject of the title if two entries announce it; else the entry's most frequent tag that fewer
    than half of all entries carry, if two such entries share it; else the kind."""
    base = entries.select("id", "kind", "title", "tags", title_subject(F.col("title")).alias("subject"))
    shared = base.where("subject is not null").groupBy("subject").agg(F.count("*").alias("_n")).where("_n >= 2")
    by_subject = base.join(shared.select("subject", F.lit(True).alias("_s")), "subject", "left")
    named = by_subject.where("_s").select("id", F.col("subject").alias("topic"), F.lit("subject").alias("basis"))
    rest = by_subject.where("_s is null").select("id", "kind", "tags")
    total = entries.agg(F.count("*").alias("_total"))
    df = entries.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("df"))
    rare = df.crossJoin(F.broadcast(total)).where(F.col("df") < F.greatest(F.floor(F.col("_total") * 0.5), F.lit(2))).select("tag", "df")  # a single row
    tagged = rest.select("id", F.explode(F.array_distinct("tags")).alias("tag")).join(rare, "tag")
    leading = tagged.groupBy("id").agg(F.min(F.struct((-F.col("df")).alias("_d"), "tag")).alias("_t")).select("id", F.col("_t.tag").alias("tag"))
    groups = leading.groupBy("tag").agg(F.count("*").alias("_n")).where("_n >= 2").select("tag", F.lit(True).alias("_g"))
    by_tag = leading.join(groups, "tag").select("id", "tag")
    left = rest.select("id", "kind").join(by_tag, "id", "left")
    others = left.select("id", F.coalesce("tag", "kind").alias("topic"), F.when(F.col("tag").isNotNull(), "tag").otherwise("kind").alias("basis"))
    return named.unionByName(others)


def topic_sizes(topics: DataFrame, entries: DataFrame, top: int = 7) -> DataFrame:
    """topic, basis, n_entries, share, newest, mean_confidence of the ``top`` topics, largest first, ties by name."""
    total = entries.agg(F.count("*").alias("_total"))
    sized = topics.join(entries.select("id", "updated", "confidence"), "id").groupBy("topic", "basis").agg(F.count("*").alias("n_entries"), F.max("updated").alias("newest"), F.avg("confidence").alias("mean_confidence"))
    leading = sized.orderBy(F.desc("n_entries"), "topic", "basis").limit(top)
    return leading.crossJoin(F.broadcast(total)).select("topic", "basis", "n_entries", (F.col("n_entries") / F.col("_total")).alias("share"), "newest", "mean_confidence")


def title_token_df(entries: DataFrame) -> DataFrame:
    """token, df over titles."""
    return entries.select(F.explode(title_tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def topic_keywords(topics: DataFrame, entries: DataFrame, k: int = 6) -> DataFrame:
    """topic, token, n, score, rank: words frequent inside a topic and rare outside: n / df * sqrt(n), for words of two
    entries or more that at most two thirds of all titles have."""
    total = entries.agg(F.count("*").alias("_total"))
    used = topics.join(entries.select("id", "title"), "id").select("topic", F.explode(title_tokens(F.col("title"))).alias("token"))
    local = used.where(F.length("token") >= 3).groupBy("topic", "token").agg(F.count("*").alias("n")).where("n >= 2")
    scored = local.join(title_token_df(entries), "token").crossJoin(F.broadcast(total)).where(F.col("df") * 3 <= F.col("_total") * 2).withColumn("score", F.col("n") / F.col("df") * F.sqrt("n"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), F.desc("n"), "token"))
    return scored.select("topic", "token", "n", "score", rank.alias("rank")).where(F.col("rank") <= k)


def satellites(topics: DataFrame, entries: DataFrame, k: int = 6) -> DataFrame:
    """topic, label, n: the tags that entries of a topic carry most."""
    tagged = topics.join(entries.select("id", F.array_distinct("tags").alias("tags")), "id").select("topic", F.explode("tags").alias("label")).where("label is not null").groupBy("topic", "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "label"))
    return tagged.withColumn("rank", rank).where(F.col("rank") <= k).select("topic", "label", "n", "rank")
