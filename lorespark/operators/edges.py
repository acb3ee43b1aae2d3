"""Graph construction: declared, version, tag and semantic edges, deduplication, budgets, nodes, exports.

Edges are rows (from_id, to_id, kind, weight, evidence). Nothing here pairs up the members of a group: tag edges join on
the rare tags of a set only, between distinct sets; semantic edges come from a stated set of query rows.

A tag set is named by the first of its entries. A ``tag`` edge runs between two sets and stands for all pairs of their
members; a ``member`` edge ties an entry to its set, and the members of a set stand for pairs of weight 1.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import subject_tags
from lorespark.operators.orphans import trimmed
from lorespark.session import cut_lineage

# Order of the kinds, and the kinds that have no direction or are never pruned.
KIND_ORDER = ["link", "supersedes", "tag", "semantic", "contradicts", "corroborates", "member"]
SYMMETRIC = ["tag", "semantic", "contradicts", "corroborates"]
LOAD_BEARING = ["link", "supersedes", "contradicts", "member"]
#: Sets of one tag that meet others at a time.
BLOCK_SETS = 2_000
#: Entries of one claim that are compared at a time: with 8192 dimensions 16 MB.
BLOCK_CLAIMS = 256


def kind_rank(kind: Column) -> Column:
    """Place of a kind in the fixed order."""
    return F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), kind)


def declared_edges(entries: DataFrame) -> DataFrame:
    """link and supersedes edges of entries, to known entries other than itself, each once.

    ``supersedes`` gives an edge from the entry to the older one; ``superseded_by`` one from the entry to the newer one.
    """
    targets = [("link", F.col("links")), ("supersedes", F.col("supersedes")), ("supersedes", F.array("superseded_by"))]
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(t, F.array().cast("array<string>")).alias("targets")) for k, t in targets])
    flat = entries.select("id", F.inline(lists)).select(F.col("id").alias("from_id"), "kind", F.explode(F.transform("targets", trimmed)).alias("to_id"))
    wanted = flat.where("to_id is not null and to_id <> from_id").distinct()
    return wanted.join(entries.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").select("from_id", "to_id", "kind", F.lit(1.0).alias("weight"), F.lit("declared").alias("evidence"))


def tag_sets(entries: DataFrame) -> DataFrame:
    """subjects, n_entries, first_id: the distinct sets of subject tags and how many entries carry each."""
    return entries.select("id", subject_tags(F.col("tags")).alias("subjects")).where(F.size("subjects") > 0).groupBy("subjects").agg(F.count("*").alias("n_entries"), F.min("id").alias("first_id"))


def tag_members(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """id, first_id, subjects: each entry with subject tags and its set in ``sets`` (see :func:`tag_sets`)."""
    return entries.select("id", subject_tags(F.col("tags")).alias("subjects")).where(F.size("subjects") > 0).join(sets.select("subjects", "first_id"), "subjects").select("id", "first_id", "subjects")


def member_edges(members: DataFrame) -> DataFrame:
    """member edges from each entry to the first of its set, one per entry."""
    return members.where("id <> first_id").select(F.col("id").alias("from_id"), F.col("first_id").alias("to_id"), F.lit("member").alias("kind"), F.lit(1.0).alias("weight"), F.concat(F.lit("same tags "), F.array_join("subjects", ", ")).alias("evidence"))


def tag_set_edges(sets: DataFrame, least: float = 0.34) -> DataFrame:
    """first_a, first_b, weight, shared: pairs of distinct subject sets with a Jaccard similarity of ``least`` or more.

    Sets meet on their rarest tags only: of n tags, the n - ceil(least * n) + 1 rarest are enough to find every pair. The
    sets of a popular tag are cut into blocks of about ``BLOCK_SETS``, and pairs of blocks are spread over the tasks; a pair
    comes out of the first tag that brings it together, so none is sent twice. Entries of the same set are its members
    (see :func:`tag_sets`), not pairs.
    """
    df = sets.select(F.explode("subjects").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    keyed = sets.select("first_id", "subjects", F.explode("subjects").alias("t")).join(df, "t")
    ordered = keyed.groupBy("first_id", "subjects").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("rare"))
    n = F.size("subjects")
    prefix = ordered.withColumn("rare", F.slice("rare", F.lit(1), (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int"))).select("first_id", "subjects", "rare", F.explode("rare").alias("t"))
    sizes = prefix.groupBy("t").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("_n"))
    own = F.pmod(F.xxhash64("first_id"), F.col("_n"))
    met = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    sent = prefix.join(sizes, "t").select("t", "first_id", "subjects", "rare", own.alias("_own"), F.inline(met))
    a = sent.where("_own = i").select("t", "i", "j", F.col("first_id").alias("_x"), F.col("subjects").alias("_a"), F.col("rare").alias("_ra"))
    b = sent.where("_own = j").select("t", "i", "j", F.col("first_id").alias("_y"), F.col("subjects").alias("_b"), F.col("rare").alias("_rb"))
    sized = F.least(F.size("_a"), F.size("_b")) >= F.lit(least) * F.greatest(F.size("_a"), F.size("_b")) - 1e-9
    once = F.array_intersect("_ra", "_rb")[0] == F.col("t")  # the first tag in the common order of the prefixes
    each = (F.col("i") < F.col("j")) | (F.col("_x") < F.col("_y"))
    pairs = a.join(b, ["t", "i", "j"]).where(each & sized & once).select(F.least("_x", "_y").alias("first_a"), F.greatest("_x", "_y").alias("first_b"), "_a", "_b")
    shared = F.array_sort(F.array_intersect("_a", "_b"))
    weight = F.size(shared) / F.size(F.array_union("_a", "_b"))
    return pairs.select("first_a", "first_b", weight.alias("weight"), F.array_join(shared, ", ").alias("shared")).where(F.col("weight") >= least - 1e-9)


def semantic_edges(neighbours: DataFrame) -> DataFrame:
    """semantic edges of nearest rows (query_id, id, similarity): a pair found from both sides counts once, stronger first."""
    pair = neighbours.groupBy(F.least("query_id", "id").alias("from_id"), F.greatest("query_id", "id").alias("to_id")).agg(F.max("similarity").alias("weight"))
    return pair.select("from_id", "to_id", F.lit("semantic").alias("kind"), "weight", F.format_string("cosine %.3f", "weight").alias("evidence"))


def claim_edges(conflicts: DataFrame) -> DataFrame:
    """contradicts edges of contradictions, one per pair with its first subject."""
    return conflicts.groupBy(F.col("id_a").alias("from_id"), F.col("id_b").alias("to_id")).agg(F.min("subject").alias("_s")).select("from_id", "to_id", F.lit("contradicts").alias("kind"), F.lit(0.8).alias("weight"), F.concat(F.lit("opposite claims on "), "_s").alias("evidence"))


def corroborations(firm: DataFrame, packed: DataFrame, least: float = 0.15, dimensions: int = 8192) -> DataFrame:
    """corroborates edges: entries that share a tag, state the same claim and have a cosine of ``least`` or more.

    ``firm`` as from claims.firm, ``packed`` vectors. Every pair of a tag and direction is compared. A group is cut into
    blocks of about ``BLOCK_CLAIMS`` entries, two of which meet in one task, and only pairs above ``least`` leave it.
    """
    blocks = firm.groupBy("tag", "net").agg(F.count("*").alias("_c")).where("_c > 1").select("tag", "net", F.ceil(F.col("_c") / BLOCK_CLAIMS).alias("_n"))
    placed = firm.join(blocks, ["tag", "net"]).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    keyed = met.select("id", "tag", "net", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")).join(packed, "id")
    kind = packed.schema["id"].dataType.simpleString()
    pairs = keyed.groupBy("tag", "net", "_i", "_j").applyInArrow(_agreeing(least, dimensions), f"from_id {kind}, to_id {kind}, weight double, tag string")
    agreed = pairs.groupBy("from_id", "to_id").agg(F.max("weight").alias("weight"), F.min("tag").alias("_s"))
    return agreed.select("from_id", "to_id", F.lit("corroborates").alias("kind"), "weight", F.concat(F.lit("same claim on "), "_s").alias("evidence"))


def _agreeing(least: float, dimensions: int):
    def agreeing(group: pa.Table) -> pa.Table:
        rows = group.select(["id", "_own", "dims", "weights"]).to_pylist()
        first, second = group["_i"][0].as_py(), group["_j"][0].as_py()
        left = [r for r in rows if r["_own"] == first]
        right = left if first == second else [r for r in rows if r["_own"] == second]
        found = []
        for at in range(0, len(left), BLOCK_CLAIMS):  # hashes spread unevenly
            part = left[at : at + BLOCK_CLAIMS]
            dense = np.zeros((dimensions, len(part)), np.float64)
            for k, r in enumerate(part):
                dense[r["dims"], k] = r["weights"]
            for r in right:
                scores = np.asarray(r["weights"]) @ dense[r["dims"]]
                for k in np.flatnonzero(scores >= least):
                    a, b = part[k]["id"], r["id"]
                    if a != b and (first != second or a < b):
                        found.append((min(a, b), max(a, b), float(scores[k])))
        ids = group.schema.field("id").type
        a, b, w = zip(*found) if found else ((), (), ())
        return pa.table({"from_id": pa.array(a, ids), "to_id": pa.array(b, ids), "weight": pa.array(w, pa.float64()), "tag": pa.array([group["tag"][0].as_py()] * len(found), pa.string())})

    return agreeing


def all_edges(*parts: DataFrame) -> DataFrame:
    """The parts as one table, each (kind, from_id, to_id) once with its greatest weight; kinds without a direction go
    from the smaller id to the greater."""
    every = reduce(DataFrame.unionByName, parts)
    turned = F.col("kind").isin(SYMMETRIC) & (F.col("from_id") > F.col("to_id"))
    straight = every.select(F.when(turned, F.col("to_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(turned, F.col("from_id")).otherwise(F.col("to_id")).alias("to_id"), "kind", "weight", "evidence")
    return straight.groupBy("from_id", "to_id", "kind").agg(F.max(F.struct("weight", "evidence")).alias("_e")).select("from_id", "to_id", "kind", "_e.weight", "_e.evidence")


def pruned(edges: DataFrame, budget: int = 24) -> DataFrame:
    """Edges within the budget: an inferred edge stays if it is among the ``budget`` strongest of both its ends; declared,
    version and conflict edges always stay and do not count."""
    kept = edges.where(F.col("kind").isin(LOAD_BEARING))
    inferred = edges.where(~F.col("kind").isin(LOAD_BEARING))
    ends = inferred.select("*", F.explode(F.array("from_id", "to_id")).alias("_end"))
    order = Window.partitionBy("_end").orderBy(F.desc("weight"), kind_rank(F.col("kind")), "from_id", "to_id")
    within = ends.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget).groupBy("from_id", "to_id", "kind", "weight", "evidence").agg(F.count("*").alias("_n"))
    return kept.unionByName(within.where("_n = 2").drop("_n"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree, weighted_degree of the nodes that have edges. Edges between tag sets count for every member, once for
    each member of the other set, from the sizes of the sets."""
    ends = edges.where(~F.col("kind").isin("tag", "member")).select(F.explode(F.array("from_id", "to_id")).alias("id"), F.lit(1).cast("bigint").alias("degree"), F.col("weight").alias("weighted_degree"))
    member = edges.where(F.col("kind") == "member").select(F.col("from_id").alias("id"), F.col("to_id").alias("_set"))
    others = member.groupBy("_set").agg(F.count("*").alias("_others"))
    tag = edges.where(F.col("kind") == "tag")
    sides = tag.select(F.col("from_id").alias("_near"), F.col("to_id").alias("_set"), "weight").unionByName(tag.select(F.col("to_id").alias("_near"), F.col("from_id").alias("_set"), "weight"))
    n = F.coalesce(F.col("_others"), F.lit(0)) + 1
    across = sides.join(others, "_set", "left").select(F.col("_near").alias("_set"), n.alias("degree"), (n * F.col("weight")).alias("weighted_degree"))
    within = others.select("_set", F.col("_others").alias("degree"), F.col("_others").cast("double").alias("weighted_degree"))
    of_set = across.unionByName(within).groupBy("_set").agg(F.sum("degree").alias("degree"), F.sum("weighted_degree").alias("weighted_degree"))
    every = ends.unionByName(of_set.withColumnRenamed("_set", "id")).unionByName(member.join(of_set, "_set").drop("_set"))
    return every.groupBy("id").agg(F.sum("degree").alias("degree"), F.sum("weighted_degree").alias("weighted_degree"))


def kind_counts(edges: DataFrame) -> DataFrame:
    """kind, n: the edges of each kind; tag edges are counted as pairs of entries, from the sizes of the sets."""
    tag = edges.where(F.col("kind").isin("tag", "member"))
    plain = edges.where(~F.col("kind").isin("tag", "member")).groupBy("kind").agg(F.count("*").alias("n"))
    pairs = degrees(tag).agg(F.expr("sum(degree) div 2").alias("n")).where("n > 0").select(F.lit("tag").alias("kind"), "n")
    return plain.unionByName(pairs)


def nodes(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """The entries with their degree, isolated ones with 0."""
    return entries.join(degrees(edges), "id", "left").fillna(0, ["degree"]).fillna(0.0, ["weighted_degree"])


def strongest(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` edges of greatest weight; ties by kind in its fixed order, then by the ends."""
    return edges.orderBy(F.desc("weight"), kind_rank(F.col("kind")), "from_id", "to_id").limit(k)


def between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The edges that join two nodes directly, in either direction."""
    return edges.where(((F.col("from_id") == a) & (F.col("to_id") == b)) | ((F.col("from_id") == b) & (F.col("to_id") == a)))


def legible(ids: DataFrame, edges: DataFrame, max_nodes: int = 500) -> tuple[DataFrame, DataFrame]:
    """The ``max_nodes`` nodes (id, degree) of greatest degree, ties by id, and the edges whose ends are both among them."""
    kept = nodes(ids.select("id"), edges).orderBy(F.desc("degree"), "id").limit(max_nodes).select("id", "degree")
    few = F.broadcast(kept.select("id"))  # ``max_nodes`` ids
    inside = edges.join(few.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(few.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return kept, inside


def omitted(ids: DataFrame, edges: DataFrame, max_nodes: int = 500) -> DataFrame:
    """One row: nodes and edges kept by :func:`legible`, and how many it leaves out."""
    kept, inside = legible(ids, edges, max_nodes)
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((kept, "kept_nodes"), (inside, "kept_edges"), (ids, "n_nodes"), (edges, "n_edges"))]
    one = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), counts)  # single rows
    return one.select("kept_nodes", "kept_edges", (F.col("n_nodes") - F.col("kept_nodes")).alias("omitted_nodes"), (F.col("n_edges") - F.col("kept_edges")).alias("omitted_edges"))


def graph_summary(n_entries: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges (see :func:`degrees`), density, mean degree, isolated nodes."""
    n = n_entries.agg(F.count("*").alias("n_nodes"))
    used = degrees(edges).agg(F.count("*").alias("_used"), F.expr("coalesce(sum(degree), 0) div 2").alias("n_edges"))
    one = n.crossJoin(F.broadcast(used))  # single rows
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return one.select("n_nodes", "n_edges", F.coalesce(F.col("n_edges") / F.nullif(pairs, F.lit(0.0)), F.lit(0.0)).alias("density"), F.coalesce(2 * F.col("n_edges") / F.nullif(F.col("n_nodes"), F.lit(0)), F.lit(0.0)).alias("mean_degree"), (F.col("n_nodes") - F.col("_used")).alias("n_isolated"))


def with_components(summary: DataFrame, components: DataFrame) -> DataFrame:
    """A graph's summary with n_components and the size of the largest; ``components``: id, component."""
    sizes = components.groupBy("component").agg(F.count("*").alias("_n"))
    return summary.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("n_components"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest"))))  # single rows


def ordinals(ids: DataFrame, column: str = "id") -> DataFrame:
    """``ids`` (distinct) with ``ordinal``, their place from 0 in order: ids are range-partitioned and numbered within each
    partition, whose sizes are the only thing that is gathered."""
    placed = cut_lineage(ids.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = placed.sparkSession.createDataFrame(before, "_p int, _before long")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return placed.withColumn("_w", within).join(F.broadcast(starts), "_p").withColumn("ordinal", F.col("_before") + F.col("_w")).drop("_p", "_w", "_before")  # one row per partition


def _framed(first: str, last: str | None, *parts: DataFrame) -> DataFrame:
    """part, line: a first line, the parts in order, and a last line."""
    spark = parts[0].sparkSession
    ends = [spark.createDataFrame([(0, first)], "part int, line string")] + ([spark.createDataFrame([(len(parts) + 1, last)], "part int, line string")] if last else [])
    return reduce(DataFrame.unionByName, [*ends, *(p.select(F.lit(i + 1).alias("part"), "line") for i, p in enumerate(parts))])


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot(nodes_: DataFrame, edges: DataFrame, least: float = 0.0) -> DataFrame:
    """part, line of a DOT graph: all nodes (id, title), and edges of weight ``least`` or more; a file has the parts in order."""
    of_nodes = nodes_.select(F.format_string('  "%s" [label="%s"];', _quoted(F.col("id")), _quoted(F.coalesce("title", F.lit("")))).alias("line"))
    of_edges = edges.where(F.col("weight") >= least).select(F.format_string('  "%s" -> "%s" [label="%s %.2f"];', _quoted(F.col("from_id")), _quoted(F.col("to_id")), F.col("kind"), F.col("weight")).alias("line"))
    return _framed("digraph vault {", "}", of_nodes, of_edges)


def mermaid(nodes_: DataFrame, edges: DataFrame, least: float = 0.0) -> DataFrame:
    """part, line of a Mermaid graph: nodes named by their place in the order of ids, edges of weight ``least`` or more."""
    placed = cut_lineage(ordinals(nodes_.select("id", "title")))
    of_nodes = placed.select(F.format_string('  n%d["%s"]', "ordinal", F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit("'"))).alias("line"))
    a, b = (placed.select(F.col("id").alias(c), F.col("ordinal").alias(f"_{c}")) for c in ("from_id", "to_id"))
    of_edges = edges.where(F.col("weight") >= least).join(a, "from_id").join(b, "to_id").select(F.format_string("  n%d -->|%s %.2f| n%d", "_from_id", "kind", "weight", "_to_id").alias("line"))
    return _framed("graph LR", None, of_nodes, of_edges)


def json_lines(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """part, line: a graph as JSON lines, one object per node (id, title) and per edge."""
    of_nodes = nodes_.select(F.to_json(F.struct("id", "title")).alias("line"))
    of_edges = edges.select(F.to_json(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "kind", "weight")).alias("line"))
    return of_nodes.select(F.lit(1).alias("part"), "line").unionByName(of_edges.select(F.lit(2).alias("part"), "line"))
