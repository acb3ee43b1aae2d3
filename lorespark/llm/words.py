"""Words of a text, their hashes, and hashes of word windows.

A *word* is one character of U+4E00-U+9FFF or an unbroken run of other letters and digits, after lower-casing; all else
only separates words. Splitting and hashing run in the JVM; windows over the hashed words are NumPy over whole Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One word, for Java's regular expressions.
WORD = "[一-鿿]|[\\p{L}\\p{N}&&[^一-鿿]]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """The words of ``text`` in order; null for null, empty for a text without words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of ``text`` in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists and all their values in one array; a null list has length 0."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(array.value_lengths().fill_null(0)).astype(np.int64)
    return lengths, array.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def windows(lengths: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of ``n`` words that lies within one list: its hash, its list, its first position there (from 0)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    rolled = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64(1)
        for i in range(n):
            factor = factor * _ODD
            rolled += hashes[i : len(rolled) + i] * factor
        inside = owner[: len(rolled)] == owner[n - 1 :]
        at = np.flatnonzero(inside)
        return mix(rolled[at]), owner[at], at - starts[owner[at]]


def ngram_sets(df: DataFrame, n: int, hashes: str = "hashes", sets: str = "grams") -> DataFrame:
    """``df`` with its column of word hashes replaced by the sorted distinct hashes of its windows of ``n`` words."""
    at = df.columns.index(hashes)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, values = flat_lists(batch.column(at))
            grams, owner, _ = windows(lengths, values, n)
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            fresh = np.ones(len(grams), bool)
            fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            counts = np.bincount(owner[fresh], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(grams[fresh].view(np.int64)))
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), lists], schema=pa.schema([*(batch.schema.field(i) for i in rest), pa.field(sets, lists.type)]))

    fields = [f for i, f in enumerate(df.schema.fields) if i != at]
    return df.mapInArrow(collect, T.StructType([*fields, T.StructField(sets, T.ArrayType(T.LongType()))]))
