"""Graph analytics as iterated joins: neighbourhoods, widest paths, components.

Every round is one join on the whole frontier and one aggregation; lineage is cut to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.session import cut_lineage


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, weight, kind: each edge from either end."""
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "weight", "kind").unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "weight", "kind"))


def neighbourhood(edges: DataFrame, origin: str, depth: int = 2, least: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
    """id, score, depth, via: nodes within ``depth`` hops; the score is the greatest product of weights over walks that
    do not return to the origin, depth the fewest hops with that score, via the node before. From a set of tags to another,
    or between members of one set, is one hop."""
    used = edges.where(F.col("weight") >= least)
    if kinds:
        used = used.where(F.col("kind").isin([*kinds, "member"] if "tag" in kinds else kinds))
    step = both_ways(used.where(~F.col("kind").isin("tag", "member")))
    between = both_ways(used.where(F.col("kind") == "tag"))
    members = used.where(F.col("kind") == "member").select(F.col("from_id").alias("_member"), F.col("to_id").alias("_set"))
    spark = edges.sparkSession
    best = spark.createDataFrame([(origin, 1.0, 0, None)], "id string, score double, depth int, via string")
    front = best
    for d in range(1, depth + 1):
        stepped = front.join(step, front.id == step.a).select(F.col("b").alias("id"), (F.col("score") * F.col("weight")).alias("score"), F.col("a").alias("via"))
        reached = stepped.unionByName(_over_sets(front, between, members)).where(F.col("id") != origin)
        every = best.unionByName(reached.select("id", "score", F.lit(d).alias("depth"), "via"))
        top = F.max(F.struct("score", (-F.col("depth")).alias("_d"), "via"))
        best = cut_lineage(every.groupBy("id").agg(top.alias("_t")).select("id", "_t.score", (-F.col("_t._d")).cast("int").alias("depth"), "_t.via"))
        front = best.where(F.col("depth") == d)
    return best.where(F.col("id") != origin)


def _over_sets(front: DataFrame, between: DataFrame, members: DataFrame) -> DataFrame:
    """id, score, via: the members of the tag sets of ``front`` and of the sets next to these. Rows are reduced to the best
    of each set before they go to its members."""
    best = F.max(F.struct("score", "via")).alias("_t")
    own = front.join(members, front.id == members["_member"], "left").groupBy(F.coalesce("_set", "id").alias("a")).agg(F.max(F.struct("score", F.col("id").alias("via"))).alias("_t")).select("a", "_t.score", "_t.via")
    next_to = own.join(between, "a").select(F.col("b").alias("id"), (F.col("score") * F.col("weight")).alias("score"), "via")
    sets = next_to.unionByName(own.withColumnRenamed("a", "id")).groupBy("id").agg(best).select("id", "_t.score", "_t.via")
    return sets.unionByName(sets.join(members, sets.id == members["_set"]).select(F.col("_member").alias("id"), "score", "via"))


def widest_paths(edges: DataFrame, origin: str, max_rounds: int = 10_000) -> DataFrame:
    """id, bottleneck, hops, via: for every node that can be reached, the greatest least weight on a path from the origin;
    hops is the length of the path found in rows of ``edges`` (a membership in a tag set is one), and via leads back along it.
    It goes on until nothing changes; paths of more than ``max_rounds`` edges raise an error."""
    step = both_ways(edges).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    best = edges.sparkSession.createDataFrame([(origin, 1.0, 0, None)], "id string, bottleneck double, hops int, via string")
    front = best
    for _ in range(max_rounds):
        reached = front.join(step, front.id == step.a).where(F.col("b") != origin).select(F.col("b").alias("id"), F.least("bottleneck", "weight").alias("bottleneck"), (F.col("hops") + 1).alias("hops"), F.col("a").alias("via"))
        top = F.max(F.struct("bottleneck", (-F.col("hops")).alias("_h"), "via"))
        joined = best.withColumn("_old", F.lit(1)).unionByName(reached.withColumn("_old", F.lit(0)))
        kept = joined.groupBy("id").agg(top.alias("_t"), F.max(F.when(F.col("_old") == 1, F.struct("bottleneck", (-F.col("hops")).alias("_h"), "via"))).alias("_o"))
        changed = ~F.col("_t").eqNullSafe(F.col("_o"))
        rows = cut_lineage(kept.select("id", "_t.bottleneck", (-F.col("_t._h")).cast("int").alias("hops"), "_t.via", changed.alias("_changed")))
        best, front = rows.drop("_changed"), rows.where("_changed").drop("_changed")
        if front.isEmpty():
            return best
    raise ValueError(f"paths are longer than {max_rounds} edges")


def route(paths: DataFrame, target: str) -> DataFrame:
    """place (0 at the origin), id, bottleneck along the widest path to ``target``; no rows if it is not reached.

    ``paths`` as from :func:`widest_paths`. The way back is followed by doubling: each round joins every node with the
    node twice as far back, and the route's nodes are those met from the target, in as many rounds as its length has bits.
    """
    jump = cut_lineage(paths.select("id", "via"))
    met = cut_lineage(paths.where(F.col("id") == target).select("id", F.lit(0).cast("bigint").alias("back")))
    span = 1
    while True:
        further = met.join(jump, "id").where("via is not null").select(F.col("via").alias("id"), (F.col("back") + span).alias("back"))
        if further.isEmpty():
            break
        met = cut_lineage(met.unionByName(further))
        twice = jump.select(F.col("id").alias("via"), F.col("via").alias("_next"))
        jump = cut_lineage(jump.join(twice, "via", "left").select("id", F.col("_next").alias("via")))
        span *= 2
    length = met.agg(F.max("back").alias("_l"))
    return met.crossJoin(F.broadcast(length)).join(paths.select("id", "bottleneck"), "id").select((F.col("_l") - F.col("back")).alias("place"), "id", "bottleneck")  # single row


def components(ids: DataFrame, edges: DataFrame, least: float = 0.0, max_rounds: int = 60) -> DataFrame:
    """id, component: the smallest id of each node's connected component; isolated nodes are their own.

    Alternating large-star and small-star steps (Kiveris et al. 2014): logarithmic rounds even on long chains, and a hub's
    neighbours are aggregated to their minimum, never gathered.
    """
    links = edges.where(F.col("weight") >= least).select(F.col("from_id").alias("u"), F.col("to_id").alias("v")).where("u <> v")
    pairs = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        large = _star(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger_only=True)
        small = cut_lineage(_star(large, larger_only=False))
        same = pairs.exceptAll(small).isEmpty() and small.exceptAll(pairs).isEmpty()
        pairs = small
        if same:
            break
    else:
        raise ValueError(f"components did not settle in {max_rounds} rounds")
    return ids.select("id").distinct().join(pairs.select(F.col("u").alias("id"), F.col("v").alias("_c")), "id", "left").select("id", F.coalesce("_c", "id").alias("component"))


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Connect neighbours of each node to the least of them and itself: the larger neighbours, or the smaller and itself."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    linked = joined.where("v < u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()
