"""References to records that do not exist (or were removed, or reached us later).

Method. Ids become integers: the trailing digits of an id (lower-case hexadecimal) are its *number*, what stands before
them and their width name its *series*. Known ids, removed ids and the targets of references are range-partitioned and
sorted by series and number, and numbered densely there, so that known ids with no unknown target between them have
contiguous numbers: they are one *run*, whatever the gaps in their digits. A target is matched as of the preceding run
start; if it lies beyond that run's end, or no run starts before it, it is missing. The known id at its place brings its
load time, the removal its time, so one sorted pass settles all three reasons and no second join is needed.

Ranges are cut by Spark at sampled keys, so no id pattern makes a partition hot; runs end at the borders of partitions.
Each distinct target is matched once (references are pre-aggregated, so a target that holds a third of all references
is one row here); only targets that can be at fault for some reference are joined back to the references.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest run of trailing hexadecimal digits read as a number; 15 digits fit a signed 64-bit integer.
NUMBER_DIGITS = 15


def trimmed(value: Column) -> Column:
    """``value`` without white space at its ends; null where nothing is left."""
    bare = F.regexp_replace(value, r"(?U)^\s+|(?<!\s)\s+$", "")
    return F.when(F.length(bare) > 0, bare)


def integer_key(id_: Column) -> dict[str, Column]:
    """``series`` and ``number`` of an id; together they are equal exactly for equal ids."""
    digits = F.regexp_extract(id_, rf"([0-9a-f]{{1,{NUMBER_DIGITS}}})$", 1)
    number = F.coalesce(F.conv(F.when(F.length(digits) > 0, digits), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    return {
        "series": F.concat(F.length(digits).cast("string"), F.lit(":"), F.regexp_replace(id_, rf"[0-9a-f]{{1,{NUMBER_DIGITS}}}$", "")),
        "number": number,
    }


_PARENT, _REMOVAL, _TARGET = 0, 1, 2


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by series, number and kind -> the targets with ``known``, ``at`` and ``removed_at``, and the run before."""
    series, number, dense = None, None, 0
    run_start, run_end, loaded, removed_key, removed = -1, -1, None, -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = pc.dictionary_encode(batch.column("series"))
        codes = np.asarray(names.indices)
        numbers, kinds = np.asarray(batch.column("number")), np.asarray(batch.column("kind"))
        other = np.append(series != names.dictionary[codes[0]].as_py(), codes[1:] != codes[:-1])
        fresh = other | np.append(number != numbers[0], numbers[1:] != numbers[:-1])
        keys = dense + np.cumsum(fresh.astype(np.int64) + other)  # a new series leaves a gap
        rows = np.arange(len(keys))
        parents = np.where(kinds == _PARENT, rows, -1)
        before = np.maximum.accumulate(np.append(-1, parents[:-1]))
        ends_before = np.where(before >= 0, keys[before], run_end)
        starts = np.where((kinds == _PARENT) & (keys - ends_before > 1), keys, -1)
        start = np.maximum(np.maximum.accumulate(starts), run_start)
        last = np.maximum.accumulate(parents)
        end = np.where(last >= 0, keys[last], run_end)
        gone = np.maximum.accumulate(np.where(kinds == _REMOVAL, rows, -1))
        gone_key = np.where(gone >= 0, keys[gone], removed_key)
        at = batch.column("at").to_pylist()
        asked = np.flatnonzero(kinds == _TARGET)
        if len(asked):
            known = (start[asked] >= 0) & (keys[asked] <= end[asked])
            loads = [(at[last[i]] if last[i] >= 0 else loaded) if k else None for i, k in zip(asked, known)]
            removals = [(at[gone[i]] if gone[i] >= 0 else removed) if gone_key[i] == keys[i] else None for i in asked]
            yield pa.RecordBatch.from_arrays(
                [batch.column("target").take(pa.array(asked)), pa.array(known), pa.array(loads, pa.int64()), pa.array(removals, pa.int64()), pa.array(np.where(start[asked] >= 0, end[asked] - start[asked] + 1, 0))],
                names=["target", "known", "loaded", "removed", "run_ids"],
            )
        series, number, dense = names.dictionary[codes[-1]].as_py(), numbers[-1], int(keys[-1])
        run_start, run_end = int(start[-1]), int(end[-1])
        loaded = at[last[-1]] if last[-1] >= 0 else loaded
        removed_key, removed = int(gone_key[-1]), at[gone[-1]] if gone[-1] >= 0 else removed


def matched_targets(targets: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """``targets`` (distinct target_id and other columns) with ``known`` (a parent has the id), ``target_loaded_at``,
    ``removed_at``, and ``run_ids``, the ids of the preceding run up to the target (0 where none starts before it).

    ``parents``: target_id, at; ``removals``: target_id, at; each id once. Null ids match nothing.
    """
    nothing = F.lit(None).cast(T.StructType(targets.schema.fields))
    parts = [
        (parents, _PARENT, F.unix_micros("at"), nothing),
        (removals, _REMOVAL, F.unix_micros("at"), nothing),
        (targets, _TARGET, F.lit(None).cast("bigint"), F.struct(*targets.columns)),
    ]
    rows = reduce(DataFrame.unionByName, [df.where("target_id is not null").select(*[c.alias(n) for n, c in integer_key(F.col("target_id")).items()], F.lit(kind).alias("kind"), at.alias("at"), row.alias("target")) for df, kind, at, row in parts])
    ordered = rows.repartitionByRange("series", "number").sortWithinPartitions("series", "number", "kind")
    out = T.StructType([T.StructField("target", T.StructType(targets.schema.fields)), *[T.StructField(n, t) for n, t in (("known", T.BooleanType()), ("loaded", T.LongType()), ("removed", T.LongType()), ("run_ids", T.LongType()))]])
    matched = ordered.mapInArrow(_matcher, out)
    return matched.select("target.*", "known", F.timestamp_micros("loaded").alias("target_loaded_at"), F.timestamp_micros("removed").alias("removed_at"), "run_ids")


def references(df: DataFrame, source_table: str, record_id: Column, reference_time: Column, fields: dict[str, Column], loaded_at: str = "loaded_at") -> DataFrame:
    """One row per record, field and distinct reference, trimmed; null and blank references and null records are none.

    ``fields`` maps a field name to an array column. Copies of a record count once, with the earliest ``loaded_at``.
    """
    lists = {n: F.array_distinct(F.filter(F.transform(c, trimmed), lambda v: v.isNotNull())) for n, c in fields.items()}
    named = F.filter(F.array(*[F.struct(F.lit(n).alias("field_name"), F.coalesce(c, F.array().cast("array<string>")).alias("targets")) for n, c in lists.items()]), lambda f: F.size(f["targets"]) > 0)
    rows = df.select(record_id.alias("record_id"), reference_time.alias("reference_time"), F.col(loaded_at).alias("record_loaded_at"), named.alias("_fields")).where("record_id is not null and size(_fields) > 0")
    flat = rows.select("record_id", "reference_time", "record_loaded_at", F.inline("_fields")).select("record_id", "reference_time", "record_loaded_at", "field_name", F.explode("targets").alias("target_id"))
    once = flat.groupBy("record_id", "field_name", "target_id").agg(F.min("record_loaded_at").alias("record_loaded_at"), F.min("reference_time").alias("reference_time"))
    return once.select(F.lit(source_table).alias("source_table"), "*")


def orphan_references(refs: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """The references at fault, with ``reason`` (the first that holds: deleted, missing, late) and ``period``.

    ``refs`` as from :func:`references`; ``parents`` has id and loaded_at (copies allowed); ``removals`` has entry_id
    and removed_at. Null reference times make no reference deleted and give a null period; null load times make none
    late. Repeated removals count with the earliest time. Empty inputs give empty or all-missing results.
    """
    per_target = refs.groupBy("target_id").agg(F.max("reference_time").alias("_last_reference"), F.min("record_loaded_at").alias("_first_load"))
    first_seen = parents.where("id is not null").groupBy(F.col("id").alias("target_id")).agg(F.min("loaded_at").alias("at"))
    removed = removals.where("entry_id is not null").groupBy(F.col("entry_id").alias("target_id")).agg(F.min("removed_at").alias("at"))
    faulty = (
        matched_targets(per_target, first_seen, removed)
        .where((~F.col("known")) | (F.col("removed_at") <= F.col("_last_reference")) | (F.col("target_loaded_at") > F.col("_first_load")))
        .select("target_id", "known", "target_loaded_at", "removed_at")
    )
    reason = (
        F.when(F.col("removed_at") <= F.col("reference_time"), "deleted")
        .when(~F.col("known"), "missing")
        .when(F.col("target_loaded_at") > F.col("record_loaded_at"), "late")
    )
    return (
        refs.join(faulty, "target_id")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("source_table", "record_id", "field_name", "target_id", "reason", F.date_format("reference_time", "yyyy-MM").alias("period"))
    )


def vault_references(entries: DataFrame, queue_items: DataFrame) -> DataFrame:
    """All references of the vault: declared ones of entries and related ids of the distiller's outputs."""
    single = F.array(F.col("superseded_by"))
    of_entries = references(entries, "entries", F.col("id"), F.col("updated"), {"supersedes": F.col("supersedes"), "superseded_by": single, "links": F.col("links")})
    of_queue = references(queue_items, "queue_items", F.col("id"), F.col("updated_at"), {"related_entry_ids": F.col("candidate.distillation.related_entry_ids")})
    return reduce(DataFrame.unionByName, [of_entries, of_queue])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphan references per table, field, reason and month, with the records and targets concerned."""
    return orphans.groupBy("source_table", "field_name", "reason", "period").agg(
        F.count("*").alias("n_references"), F.count_distinct("record_id").alias("n_records"), F.count_distinct("target_id").alias("n_targets")
    )
