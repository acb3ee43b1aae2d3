"""From classes of equal records to pairs of records, without a task that pairs up a whole class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.staging import small, staged

#: Members of a class that one block holds on average: a task pairs up two blocks.
BLOCK_MEMBERS = 2_000


def blocks_of(n: Column, size: int) -> Column:
    """The number of blocks of ``size`` rows that ``n`` rows take."""
    return F.ceil(n / F.lit(size)).cast("int")


def every_block_pair(n_a: Column, n_b: Column, same: Column) -> Column:
    """Array of (i, j): all pairs of the blocks of two groups, of one group (``same``) each pair once."""
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pairs = F.flatten(F.transform(upto(n_a), lambda i: F.transform(upto(n_b), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return F.filter(pairs, lambda p: ~same | (p["i"] <= p["j"]))


def member_pairs(similar: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of members of similar classes, and of members of one class: ``a`` and ``b``, structs of the members' columns.

    ``similar``: class_a, class_b (different classes, each pair once); ``members``: class_key and other columns, each row
    once. Two members of one class come out once, in either order. Classes of more than ``BLOCK_MEMBERS`` members are cut
    into blocks, and pairs of blocks are spread over the tasks.
    """
    counts = members.groupBy("class_key").agg(F.count("*").alias("n")).where("n > 1")
    counted = staged(counts.select("class_key", blocks_of(F.col("n"), BLOCK_MEMBERS).alias("_blocks")))
    large = small(staged(counted.where("_blocks > 1")))
    row = F.struct(*[c for c in members.columns if c != "class_key"])
    cut = members.join(large, "class_key", "left").select("class_key", F.pmod(F.xxhash64(row), F.coalesce("_blocks", F.lit(1))).cast("int").alias("_block"), row.alias("_row"))
    n = lambda c: F.coalesce(F.col(c), F.lit(1))
    sized_a, sized_b = large.select(F.col("class_key").alias("class_a"), F.col("_blocks").alias("_na")), large.select(F.col("class_key").alias("class_b"), F.col("_blocks").alias("_nb"))
    between = similar.select("class_a", "class_b").join(sized_a, "class_a", "left").join(sized_b, "class_b", "left")
    within = counted.select(F.col("class_key").alias("class_a"), F.col("class_key").alias("class_b"), F.col("_blocks").alias("_na"), F.col("_blocks").alias("_nb"))
    same = F.col("class_a") == F.col("class_b")
    tasks = between.unionByName(within).select("class_a", "class_b", F.inline(every_block_pair(n("_na"), n("_nb"), same)))
    a = cut.select(F.col("class_key").alias("class_a"), F.col("_block").alias("i"), F.col("_row").alias("a"))
    b = cut.select(F.col("class_key").alias("class_b"), F.col("_block").alias("j"), F.col("_row").alias("b"))
    pairs = tasks.join(a, ["class_a", "i"]).join(b, ["class_b", "j"])
    return pairs.where(~same | (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))).select("a", "b")
