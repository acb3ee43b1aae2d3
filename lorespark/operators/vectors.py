"""Signed-hash TF-IDF vectors: vocabulary, vectors, nearest rows, explanations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.hashing import signed_dimension
from lorespark.functions.text import tokens
from lorespark.session import cut_lineage

#: Weights nearer to zero are dropped.
LEAST_WEIGHT = 1e-4
#: Weights of query vectors that one broadcast block holds (12 bytes each).
BLOCK_WEIGHTS = 4_000_000
#: Terms kept to explain a dimension.
TERMS_PER_DIMENSION = 3


def term_counts(texts: DataFrame) -> DataFrame:
    """id, token, tf of ``texts`` (id, text); texts that are null or without tokens have no rows."""
    return texts.select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, dimensions: int = 8192) -> DataFrame:
    """token, df, dim, sign: each token with its document frequency and its place in the hashed space."""
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("_p", signed_dimension(dimensions)("token")).select("token", "df", "_p.dim", "_p.sign")


def vectors(counts: DataFrame, vocab: DataFrame, n_documents: int) -> DataFrame:
    """id, dim, weight: L2-normalised vectors in long form. Tokens outside the vocabulary are dropped."""
    return packed_vectors(counts, vocab, n_documents).select("id", F.explode(F.arrays_zip("dims", "weights")).alias("_v")).select("id", F.col("_v.dims").alias("dim"), F.col("_v.weights").alias("weight"))


def packed_vectors(counts: DataFrame, vocab: DataFrame, n_documents: int) -> DataFrame:
    """id, dims, weights: L2-normalised vectors, dimensions rising; rows without a token of the vocabulary are left out.

    The tokens of a text are gathered once (a text has no more than its words); tokens of one dimension are summed and the
    vector is normalised within the row.
    """
    idf = F.log(1 + (F.lit(n_documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = counts.join(vocab, "token").select("id", "dim", (F.col("sign") * (1 + F.log("tf")) * idf).alias("w"))
    gathered = weighed.groupBy("id").agg(F.collect_list("dim").alias("dims"), F.collect_list("w").alias("weights"))
    kind = counts.schema["id"].dataType.simpleString()
    return gathered.mapInArrow(_normalised, f"id {kind}, dims array<int>, weights array<double>")


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(batch.column("dims").value_lengths()).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), lengths)
        dims, weights = batch.column("dims").flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
        order = np.lexsort((weights, dims, owner))  # a sum in one order, whatever the order of the rows
        owner, dims, weights = owner[order], dims[order], weights[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (dims[1:] != dims[:-1])))
        sums, owner, dims = np.add.reduceat(weights, first), owner[first], dims[first]
        kept = np.abs(sums) >= LEAST_WEIGHT
        sums, owner, dims = sums[kept], owner[kept], dims[kept]
        norms = np.sqrt(np.bincount(owner, sums * sums, batch.num_rows))
        sizes = np.bincount(owner, minlength=batch.num_rows)
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (dims.astype(np.int32), sums / norms[owner])]
        out = pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "dims", "weights"])
        yield out.filter(pa.array(sizes > 0))


def dimension_terms(vocab: DataFrame) -> DataFrame:
    """dim, terms: the most frequent terms that fall on a dimension."""
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("df"), "token"))
    kept = vocab.withColumn("_r", rank).where(F.col("_r") <= TERMS_PER_DIMENSION)
    return kept.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "token"))), lambda x: x["token"]).alias("terms"))


def packed(rows: DataFrame) -> DataFrame:
    """id, dims, weights: one row per vector, dimensions rising (a vector has at most as many as the space)."""
    pairs = F.array_sort(F.collect_list(F.struct("dim", "weight")))
    return rows.groupBy("id").agg(pairs.alias("_v")).select("id", F.col("_v.dim").alias("dims"), F.col("_v.weight").alias("weights"))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 8, least: float = 0.08, dimensions: int = 8192) -> DataFrame:
    """query_id, id, similarity, rank: the ``k`` rows most similar to each query, itself left out, above ``least``.

    ``queries`` and ``rows`` are packed vectors. Queries go in blocks of at most about ``BLOCK_WEIGHTS`` weights, as inverted
    lists by dimension; a block is broadcast and every row is scored against it in one scan without a shuffle, keeping the
    best ``k`` of each task; only those are shuffled. With several blocks each is written before the next is sent, so one
    is held at a time. Ties break by id.
    """
    spark = rows.sparkSession
    total = queries.agg(F.sum(F.size("dims"))).first()[0] or 0
    blocks = -(-total // BLOCK_WEIGHTS) or 1
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    kind = rows.schema["id"].dataType.simpleString()
    found = None
    for b in range(blocks):
        block = numbered.where(F.col("_b") == b).select("id", "dims", "weights").toArrow()  # one block of queries
        shared = spark.sparkContext.broadcast(_inverted(block, dimensions))
        part = rows.mapInArrow(_scorer(shared, k, least), f"query_id {kind}, id {kind}, similarity double")
        if blocks > 1:
            part = cut_lineage(part)
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _inverted(block: pa.Table, dimensions: int) -> tuple:
    """Names of the queries, and for each dimension the range of its (query, weight) entries."""
    dims, weights = block.column("dims").combine_chunks(), block.column("weights").combine_chunks()
    owner = np.repeat(np.arange(block.num_rows), np.asarray(dims.value_lengths().fill_null(0)).astype(np.int64)).astype(np.int32)
    at = dims.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    return block.column("id").to_pylist(), np.searchsorted(at[order], np.arange(dimensions + 1)), owner[order], weights.flatten().to_numpy(zero_copy_only=False)[order]


def _scorer(shared, k: int, least: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranges, owner, entries = shared.value
        own = {name: j for j, name in enumerate(names)}
        best: list[list[tuple]] = [[] for _ in names]
        kind = None
        for batch in batches:
            kind = batch.column("id").type
            ids = batch.column("id").to_pylist()
            dims, weights = batch.column("dims"), batch.column("weights")
            at = np.concatenate([[0], np.cumsum(np.asarray(dims.value_lengths().fill_null(0)))])
            all_dims, all_weights = dims.flatten().to_numpy(), weights.flatten().to_numpy()
            for i, name in enumerate(ids):
                d, w = all_dims[at[i] : at[i + 1]], all_weights[at[i] : at[i + 1]]
                first, n = ranges[d], ranges[d + 1] - ranges[d]
                ends = np.cumsum(n)
                if not len(ends) or not ends[-1]:
                    continue
                met = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
                scores = np.bincount(owner[met], entries[met] * np.repeat(w, n), len(names))
                for j in np.flatnonzero(scores > least):
                    if own.get(name) != j:
                        best[j].append((-scores[j], name))
                        if len(best[j]) > 8 * k:
                            best[j].sort()
                            del best[j][k:]
        rows = [(names[j], name, -s) for j, held in enumerate(best) for s, name in sorted(held)[:k]]
        if rows:
            q, n, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, kind), pa.array(n, kind), pa.array(s, pa.float64())], names=["query_id", "id", "similarity"])

    return score


def shared_terms(pairs: DataFrame, rows: DataFrame, terms: DataFrame, n: int = 4) -> DataFrame:
    """id_a, id_b, terms: for each pair the leading terms of the ``n`` dimensions that contribute most to its cosine."""
    a = rows.select(F.col("id").alias("id_a"), "dim", F.col("weight").alias("_wa"))
    b = rows.select(F.col("id").alias("id_b"), "dim", F.col("weight").alias("_wb"))
    shared = pairs.select("id_a", "id_b").join(a, "id_a").join(b, ["id_b", "dim"]).join(terms, "dim")
    order = Window.partitionBy("id_a", "id_b").orderBy(F.desc(F.abs(F.col("_wa") * F.col("_wb"))), F.col("terms")[0])
    kept = shared.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return kept.groupBy("id_a", "id_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col("terms")[0].alias("t")))), lambda x: x["t"]).alias("terms"))
