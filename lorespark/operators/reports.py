"""Reports over entries: filters, pages, distributions, histograms, densities, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.scores import gaussian


def filtered(entries: DataFrame, kind: str | None = None, status: str | None = None, all_tags: list[str] | None = None, agent: str | None = None, text: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Entries that meet every condition given; ``text`` is a case-insensitive part of title, body, id or any tag."""
    out = entries
    if kind:
        out = out.where(F.col("kind") == kind)
    if status:
        out = out.where(F.col("status") == status)
    if all_tags:
        out = out.where(F.size(F.array_except(F.array(*[F.lit(t) for t in all_tags]), "tags")) == 0)
    if agent:
        out = out.where(F.array_contains("source_agents", agent))
    if text and text.strip():
        needle = text.strip().lower()
        inside = [F.lower(c).contains(needle) for c in ("title", "body", "id")]
        out = out.where(inside[0] | inside[1] | inside[2] | F.exists("tags", lambda t: F.lower(t).contains(needle)))
    if least is not None:
        out = out.where(F.col("effective_confidence") >= least)
    if most is not None:
        out = out.where(F.col("effective_confidence") <= most)
    return out


def page(entries: DataFrame, offset: int = 0, limit: int = 50, order: str = "updated") -> DataFrame:
    """One page, newest first, ties by id; at most 200 rows."""
    return entries.orderBy(F.desc(order), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 200))


def counts_of(entries: DataFrame, column: str, many: bool = False) -> DataFrame:
    """value, n: entries per value; with ``many`` the column is an array and each entry counts once per value."""
    value = F.explode(F.array_distinct(column)) if many else F.col(column)
    return entries.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, n for ``bins`` equal bins of [0, 1], empty ones included; values beyond go to the last bin, nulls to none."""
    spark = values.sparkSession
    at = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    counted = values.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """n, mean, deviation (of the population) and the upper median, exact without gathering: the value of rank n / 2 + 1."""
    totals = values.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    # the distinct values are ranked over ranges of values, so no task holds them all
    bucket = counted.withColumn("_b", F.least(F.greatest(F.floor(F.col("v") * 1024), F.lit(-1)), F.lit(1024)))  # at most 1026 ranges
    sizes = bucket.groupBy("_b").agg(F.sum("k").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    middle = before.crossJoin(F.broadcast(totals.select("n"))).where("_before <= floor(n / 2) and floor(n / 2) < _before + _n").select("_b", "_before", "n")
    ranked = bucket.join(F.broadcast(middle), "_b").withColumn("_upto", F.col("_before") + F.sum("k").over(Window.partitionBy("_b").orderBy("v")))
    median = ranked.where("_upto > floor(n / 2)").agg(F.min("v").alias("median"))
    return totals.crossJoin(F.broadcast(median))


def density(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """at, density: a Gaussian kernel estimate at the right edge of each bin. Equal values are counted first, and each task
    sends one partial sum per edge. The bandwidth is 0.75 / sqrt(n), within 0.05 and 0.14."""
    cells = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    total = values.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    width = F.greatest(F.lit(0.05), F.least(F.lit(0.14), 0.75 / F.sqrt("n")))
    edges = F.explode(F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: i / F.lit(bins))).alias("at")
    spread = cells.crossJoin(F.broadcast(total)).select("v", "k", "n", edges)
    return spread.groupBy("at").agg((F.sum(F.col("k") * gaussian(F.col("v"), F.col("at"), width)) / F.first("n")).alias("density"))


def above_levels(values: DataFrame, column: str, levels: list[float]) -> DataFrame:
    """level, n_above (at or above), n_below."""
    return values.agg(F.array(*[F.struct(F.lit(x).alias("level"), F.count_if(F.col(column) >= x).alias("n_above"), F.count_if(F.col(column) < x).alias("n_below")) for x in levels]).alias("a")).select(F.inline("a"))


def activity(entries: DataFrame, column: str, today: Column, days: int = 14) -> DataFrame:
    """day, n for each of the last ``days`` days, quiet ones included."""
    spark = entries.sparkSession
    last = F.to_date(today)
    counted = entries.where((F.to_date(column) > F.date_sub(last, days)) & (F.to_date(column) <= last)).groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias("n"))
    spine = spark.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    return spine.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def ranked_with_rest(counts: DataFrame, top: int = 6, rest: str = "others") -> DataFrame:
    """value, n of the ``top`` values (ties by value) and one row with the sum of all others."""
    leaders = counts.orderBy(F.desc("n"), "value").limit(top).select("value", "n", F.lit(True).alias("_top"))
    marked = counts.join(F.broadcast(leaders.select("value", "_top")), "value", "left")
    return marked.groupBy(F.when(F.col("_top"), F.col("value")).otherwise(rest).alias("value")).agg(F.sum("n").alias("n"), F.count("*").alias("n_values"))


def violations(entries: DataFrame, kinds: list[str], statuses: list[str]) -> DataFrame:
    """id, problem: one row for each rule an entry breaks."""
    rules = [
        ("blank id", F.coalesce(F.trim("id"), F.lit("")) == ""),
        ("blank title", F.coalesce(F.trim("title"), F.lit("")) == ""),
        ("long title", F.octet_length("title") > 240),
        ("confidence out of range", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        ("negative decay rate", F.coalesce(F.col("decay_rate") < 0, F.lit(True))),
        ("unknown kind", ~F.coalesce(F.col("kind").isin(kinds), F.lit(False))),
        ("unknown status", ~F.coalesce(F.col("status").isin(statuses), F.lit(False))),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda p: p.isNotNull())
    return entries.select("id", F.explode(found).alias("problem"))
