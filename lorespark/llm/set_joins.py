"""All pairs of set-valued records whose sets overlap strongly: T-occurrence over partitioned inverted lists.

1. Records with the same set form one class. A set is an array of 64-bit value hashes in one global order: values that
   are not frequent first, then frequent ones by rising count. Frequent means at least ``1 / FREQUENT`` of all values,
   so there are at most ``FREQUENT`` of them, and their table may be broadcast. The order decides only how much is sent.
2. A set sends itself to the partitions of its first values: as an index record for partners of its size or larger, as
   a probe for partners of its size or smaller. Two sets that overlap enough meet in the partition of a shared first
   value (prefix filter). A value with more than ``BLOCK`` index records, however rare beside the others, has its partition
   split into blocks of index records; probes go to each block.
3. In a partition the index records form inverted lists. A probe asks which records occur in at least T of its lists:
   the longest lists are set aside, the others are merged with a heap that skips what cannot reach the rest of T, and
   the longest are binary-searched for the records that remain (:func:`occurrences`). Probes are streamed; only the index
   records of one block are in memory.
4. The result is the pairs of classes with the members of each (:func:`similar_set_classes`); :func:`similar_set_pairs`
   expands them to pairs of ids, in blocks.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.pairs import blocks_of, member_pairs
from lorespark.llm.staging import small, staged

#: Bound on the number of frequent values.
FREQUENT = 5_000
#: Index records of a value that one block holds on average.
BLOCK = 20_000
#: Weight of a heap step against a binary search when lists are set aside.
SEARCH_WEIGHT = 0.5


def least_overlap(a: int, b: int, threshold: float) -> int:
    """The shared values that sets of ``a`` and ``b`` values need for a Jaccard similarity of ``threshold``."""
    return math.ceil(threshold * (a + b) / (1 + threshold) - 1e-9)


def occurrences(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """The numbers that stand in at least ``least`` of the sorted ``lists``, each with its count, in rising order."""
    lists = sorted((x for x in lists if x), key=len)
    if least < 1 or len(lists) < least:
        return
    longest = len(lists[-1])
    aside = min(least - 1, int(least / (SEARCH_WEIGHT * math.log2(longest + 1) + 1)))
    long, short = lists[len(lists) - aside :], lists[: len(lists) - aside]
    need = least - aside
    at = [0] * len(short)
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= need:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            count = len(popped)
            for x in long:
                k = bisect_left(x, value)
                count += k < len(x) and x[k] == value
            if count >= least:
                yield value, count
            target = value + 1
        else:  # nothing below the need-th smallest head can occur often enough
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
        for i in popped:
            at[i] = bisect_left(short[i], target, at[i])
            if at[i] < len(short[i]):
                heapq.heappush(heap, (short[i][at[i]], i))


def _sender(frequent: dict[int, int], threshold: float):
    """Sets -> rows of the partitions they go to."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, sides, values in zip(*(batch.column(n).to_pylist() for n in ("class_key", "sides", "values"))):
                values.sort(key=lambda v: (frequent.get(v, 0), v))
                n = len(values)
                held = n - least_overlap(n, n, threshold) + 1
                asked = n - math.ceil(threshold * n - 1e-9) + 1
                for i, v in enumerate(values[: max(held, asked)]):
                    if i < held:
                        out.append((v, False, n, key, sides, values))
                    if i < asked:
                        out.append((v, True, n, key, sides, values))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _ROUTED.types)], schema=_ROUTED)

    return send


_ROUTED = pa.schema([("value", pa.int64()), ("probe", pa.bool_()), ("size", pa.int32()), ("class_key", pa.int64()), ("sides", pa.int32()), ("values", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("class_a", pa.int64()), ("class_b", pa.int64())])


def _prober(threshold: float, between: bool):
    """Rows sorted by partition, index records by size before probes -> similar pairs of classes."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sizes, keys, sides, lists = None, [], [], [], {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            for value, block, asks, n, key, side, values in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (value, block) != here:
                    here, sizes, keys, sides, lists = (value, block), [], [], [], {}
                if not asks:
                    for v in values:
                        lists.setdefault(v, []).append(len(keys))
                    sizes.append(n), keys.append(key), sides.append(side)
                    continue
                low = bisect_left(sizes, math.ceil(threshold * n - 1e-9))
                high = bisect_left(sizes, n + 1)
                if low == high:
                    continue
                found = [x[bisect_left(x, low) : bisect_left(x, high)] for v in values if (x := lists.get(v))]
                for i, count in occurrences(found, least_overlap(n, sizes[low], threshold)):
                    if keys[i] == key or sizes[i] == n and keys[i] > key or count < least_overlap(n, sizes[i], threshold):
                        continue
                    if between and side | sides[i] != 3:
                        continue
                    out.append((min(key, keys[i]), max(key, keys[i])))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIRS)

    return probe


def similar_set_pairs(sets: DataFrame, threshold: float = 0.6, least_values: int = 3, other: DataFrame | None = None) -> DataFrame:
    """All pairs of different ids of one field_name whose sets have a Jaccard similarity of ``threshold`` or more.

    ``sets``: field_name, id, values (array of strings; further columns are ignored). Within one table the result has
    id_a < id_b, each pair once; with ``other`` (same columns) id_a is of ``sets`` and id_b of ``other``. Null values
    count as absent and repeated ones once; records with fewer than ``least_values`` values, null ids or null arrays are
    in no pair; repeated rows count once, several sets of one id each count; empty tables give empty results. Every
    pair comes out (values are compared by 64-bit hashes).
    """
    similar, members = similar_set_classes(sets, threshold, least_values, other)
    pairs = member_pairs(similar, members)
    if other is not None:
        of_a = F.when(F.col("a.side") == 1, F.col("a")).otherwise(F.col("b"))
        of_b = F.when(F.col("a.side") == 1, F.col("b")).otherwise(F.col("a"))
        return pairs.where("a.side <> b.side").select("a.field_name", of_a["id"].alias("id_a"), of_b["id"].alias("id_b")).distinct()
    return pairs.where("a.id <> b.id").select("a.field_name", F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b")).distinct()


def similar_set_classes(sets: DataFrame, threshold: float = 0.6, least_values: int = 3, other: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar classes (class_a < class_b), each once, and the members of all classes (class_key, field_name, id,
    side: 1, or 2 for ``other``). Arguments as for :func:`similar_set_pairs`. Nothing here grows with the square of a class.
    """
    if threshold <= 0 or threshold > 1:
        raise ValueError("the threshold must be in (0, 1]")
    between = other is not None
    sides = [sets.select("field_name", "id", "values", F.lit(1).alias("side"))]
    if between:
        sides.append(other.select("field_name", "id", "values", F.lit(2).alias("side")))
    every = sides[0] if not between else sides[0].unionByName(sides[1])
    hashed = F.array_sort(F.array_distinct(F.transform(F.filter("values", lambda v: v.isNotNull()), lambda v: F.xxhash64("field_name", v))))
    rows = staged(
        every.where("field_name is not null and id is not null and values is not null")
        .select("field_name", "id", "side", hashed.alias("values"))
        .where(F.size("values") >= least_values)
        .distinct()
        .select("field_name", "id", "side", F.xxhash64("field_name", "values").alias("class_key"), "values")
    )
    members = rows.select("class_key", "field_name", "id", "side")
    classes = staged(rows.groupBy("class_key", "values").agg(F.bit_or("side").alias("sides")))
    counts = staged(classes.select(F.explode("values").alias("value")).groupBy("value").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = {r["value"]: r["count"] for r in counts.where(F.col("count") >= max(2, total / FREQUENT)).collect()}  # at most FREQUENT rows
    routed = classes.mapInArrow(_sender(frequent, threshold), "value bigint, probe boolean, size int, class_key bigint, sides int, values array<bigint>")
    if not counts.where(F.col("count") > BLOCK).isEmpty():  # only such values can have more index records
        routed = staged(routed)
        held = staged(routed.where("not probe").groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("value", blocks_of(F.col("n"), BLOCK).alias("_blocks")))
        blocks = F.coalesce("_blocks", F.lit(1))
        sent = F.when(F.col("probe"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod("class_key", blocks).cast("int")))
        routed = routed.join(small(held), "value", "left").select("value", F.explode(sent.cast("array<bigint>")).alias("block"), "probe", "size", "class_key", "sides", "values")
    else:
        routed = routed.select("value", F.lit(0).cast("bigint").alias("block"), "probe", "size", "class_key", "sides", "values")
    similar = (
        routed.repartition("value", "block")
        .sortWithinPartitions("value", "block", "probe", "size", "class_key")
        .mapInArrow(_prober(threshold, between), "class_a bigint, class_b bigint")
        .distinct()
    )
    return similar, members
