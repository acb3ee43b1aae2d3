"""Evaluation texts that leak into training text.

The word n-grams of the held-out items are hashed once and broadcast (their number is checked: the items are a fixed,
small table; a larger one goes through blocks of items, each with its own broadcast and pass). A scan of the documents, without any
shuffle, looks up every window of ``n`` words; hits are verified word by word against the item's text, and overlapping
hits are joined to spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.staging import staged
from lorespark.llm.words import flat_lists, windows, word_hashes, words

#: n-grams of items that one broadcast table holds (16 bytes each).
BLOCK_GRAMS = 4_000_000

_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("item_at", pa.int32()), ("at", pa.int32())]))


def _scanner(table, n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, start, end, items, places = table.value
        for batch in batches:
            lengths, hashes = flat_lists(batch.column(batch.num_columns - 1))
            found, owner, at = windows(lengths, hashes, n)
            if not len(grams) or not len(found):
                continue
            k = np.searchsorted(grams, found)
            k[k == len(grams)] = 0
            hit = np.flatnonzero(grams[k] == found)
            if not len(hit):
                continue
            k, owner, at = k[hit], owner[hit], at[hit]
            times = end[k] - start[k]
            which = np.repeat(start[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            owner, at = np.repeat(owner, times), np.repeat(at, times)
            docs, first = np.unique(owner, return_index=True)
            values = pa.StructArray.from_arrays([pa.array(items[which]), pa.array(places[which]), pa.array((at + 1).astype(np.int32))], fields=list(_HITS.value_type))
            hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), values)
            rows = batch.take(pa.array(docs))  # the hashes are the last column
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], hits.cast(_HITS)], schema=pa.schema([*list(batch.schema)[:-1], pa.field("_hits", _HITS)]))

    return scan


def _item_grams(items: DataFrame, n: int) -> tuple[np.ndarray, ...]:
    """Sorted distinct n-gram hashes of the items; for each the range of (item, place) rows that have it."""
    rows = items.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") >= n).collect()
    if not rows:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, none.astype(np.int32)
    ids = np.array([r["item_id"] for r in rows], np.int64)
    lengths = np.array([len(r["h"]) for r in rows], np.int64)
    grams, owner, at = windows(lengths, np.array([x for r in rows for x in r["h"]], np.int64).view(np.uint64), n)
    order = np.argsort(grams, kind="stable")
    grams, owner, at = grams[order], owner[order], at[order]
    distinct, start = np.unique(grams, return_index=True)
    return distinct, start, np.append(start[1:], len(grams)), ids[owner], (at + 1).astype(np.int32)


def leaked_windows(documents: DataFrame, items: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row and verified hit: doc_id, text and ``leaked`` (item_id, item_at, at): the window of ``n``
    words from place ``at`` (from 1) of the document stands in the item from place ``item_at``.

    Items and documents with a null or shorter text have no hits; a null item_id is no item; empty tables give an empty
    result; repeated document rows each come out; repeated item rows count once; other columns are ignored.
    """
    documents = documents.select(doc_id, text)
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    sized = items.select("item_id", "text", F.greatest(F.lit(0), F.size(words(F.col("text"))) - (n - 1)).cast("bigint").alias("_g"))
    total = sized.agg(F.sum("_g")).first()[0] or 0
    blocks = -(-total // BLOCK_GRAMS) or 1
    spark = documents.sparkSession
    out = T.StructType([*documents.schema.fields, T.StructField("_hits", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_at", T.IntegerType()), T.StructField("at", T.IntegerType())])))])
    prepared = documents.select("*", word_hashes(F.col(text)).alias("_hashes"))
    passes = []
    for b in range(blocks):
        held = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text")
        tabled = spark.sparkContext.broadcast(_item_grams(held, n))
        hit = prepared.mapInArrow(_scanner(tabled, n), out)
        if blocks > 1:  # one table is held at a time
            hit = staged(hit)
            tabled.unpersist()
        own = hit.withColumn("_own", words(F.col(text))).withColumn("leaked", F.explode("_hits")).withColumn("_own", F.slice("_own", F.col("leaked.at"), n))
        texts = F.broadcast(held.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("_words")))  # one block of items
        same = (F.col("leaked.item_id") == F.col("_item")) & (F.slice("_words", F.col("leaked.item_at"), n) == F.col("_own"))
        passes.append(own.join(texts, same).drop("_own", "_hits", "_item", "_words"))
    return reduce(DataFrame.unionByName, passes)


def leaked_items(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document and item it reveals."""
    return hits.select(doc_id, F.col("leaked.item_id").alias("item_id")).distinct()


def leaked_spans(places: Column, n: int) -> Column:
    """Array of (first, last) places of the words that windows from ``places`` on cover, adjacent ones joined."""
    places = F.array_sort(F.array_distinct(places))
    start = F.array().cast("array<struct<first:int,last:int>>")

    def join(spans, at):
        last = F.element_at(spans, -1)
        joined = F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(F.struct(last["first"].alias("first"), (at + (n - 1)).cast("int").alias("last"))))
        return F.when((F.size(spans) > 0) & (at <= F.try_element_at(spans, F.lit(-1))["last"] + 1), joined).otherwise(F.concat(spans, F.array(F.struct(at.cast("int").alias("first"), (at + (n - 1)).cast("int").alias("last")))))

    return F.aggregate(places, start, join)


def _cutter(n: int):
    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        import regex

        word = regex.compile("[一-鿿]|[[\\p{L}\\p{N}]--[一-鿿]]+", regex.V1)
        out = []
        for t, own in zip(text, spans):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            at = [m.span() for m in word.finditer(t)]
            parts, done = [], 0
            for s in own:
                parts.append(t[done : at[min(s["first"], len(at)) - 1][0]])
                done = at[min(s["last"], len(at)) - 1][1]
            out.append("".join(parts) + t[done:])
        return pd.Series(out, dtype=object)

    return cut


def without_leaks(hits: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document of :func:`leaked_windows`: doc_id, the text with the leaked spans cut out, the number of
    words removed. The windows of one document are gathered, at most one for each of its words."""
    spans = hits.groupBy(doc_id).agg(F.first(text).alias(text), F.collect_set("leaked.at").alias("_at")).withColumn("_spans", leaked_spans(F.col("_at"), n))
    removed = F.aggregate("_spans", F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1)
    return spans.select(doc_id, _cutter(n)(F.col(text), F.col("_spans")).alias(text), removed.alias("n_words_removed"))
