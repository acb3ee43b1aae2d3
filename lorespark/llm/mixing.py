"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer, counted once per document in Arrow batches. Target shares become token quotas by
capped water-filling: a source that cannot fill its quota with ``max_repeats`` uses of every document is clamped there, and
what it leaves is spread over the others in proportion to their shares, until nothing changes. A quota is a number of
whole repetitions of all documents of the source and a fraction: the documents of the fraction are those with the
smallest seeded hashes, cut where their tokens reach it. The cut is found by histograms of hashes, each with ``BINS`` bins per
source: the bin in which the cut falls is split again, ``LEVELS`` times, and a running sum is taken in the last one, which
holds one document in ``BINS ** LEVELS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.staging import staged

#: Hash bins per source (a power of two), and how often the bin that holds the cut is split.
BINS, LEVELS = 1024, 3
#: How the texts of rank files are split before the merges (fixed value, as published with the vocabularies).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Folder of the vocabularies of public tokenizers.
TOKENIZERS = "/opt/tokenizers"
#: Sources a mixture may name: their table goes through the driver.
MAX_SOURCES = 100_000


def _load(folder: str, file: str):
    """A function from texts to token counts. Special tokens count as ordinary text."""
    if file.endswith(".tiktoken"):
        import base64
        from pathlib import Path

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (Path(folder) / file).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{file}")
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/{file}")
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``documents`` with ``out``, the tokens of ``text``, instead of the text; a null text has 0 tokens."""
    at = documents.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _load(folder, tokenizer)
        for batch in batches:
            counts = pa.array(measure([t or "" for t in batch.column(at).to_pylist()]), pa.int64())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), counts], schema=pa.schema([*(batch.schema.field(i) for i in rest), pa.field(out, pa.int64())]))

    return documents.mapInArrow(count, T.StructType([*(f for i, f in enumerate(documents.schema.fields) if i != at), T.StructField(out, T.LongType())]))


def water_fill(shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Quotas that sum to ``total``, in proportion to ``shares`` but none above its cap; less if all are capped.

    Shares that are null, negative or zero get nothing; shares need not sum to 1.
    """
    open_ = {s: w for s, w in shares.items() if w is not None and w > 0}
    quotas = dict.fromkeys(shares, 0.0)
    left = float(total)
    while open_ and left > 0:
        scale = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * scale >= caps.get(s, 0.0)]
        if not full:
            return quotas | {s: w * scale for s, w in open_.items()}
        for s in full:
            quotas[s] = float(caps.get(s, 0.0))
            left -= quotas[s]
            del open_[s]
    return quotas


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """The chosen documents: doc_id, source, n_tokens, repeats (1 or more, at most the source's max_repeats).

    ``documents``: doc_id, source, text; ``targets``: source, target_share, max_repeats (one row per source; a repeated
    source counts with its greatest share and least cap). ``total_tokens`` defaults to all tokens of the sources named.
    Documents of other or null sources, with a null doc_id or without tokens are not chosen; a source without documents
    leaves its share to the others; a null max_repeats means 1. Repeated rows of a doc_id count once. Empty tables give
    an empty result. The same seed gives the same documents.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    listed = wanted.limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"a mixture names at most {MAX_SOURCES} sources")
    named = F.broadcast(wanted.select("source"))
    counted = token_counts(documents.where("doc_id is not null").join(named, "source", "left_semi").select("doc_id", "source", "text"), tokenizer, folder)
    once = counted.where("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens")
    sized = staged(once.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")))
    have = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # at most MAX_SOURCES rows
    total = sum(have.values()) if total_tokens is None else total_tokens
    quotas = water_fill({r["source"]: r["target_share"] for r in listed}, {r["source"]: have.get(r["source"], 0) * max(r["max_repeats"], 0) for r in listed}, total)
    plan = {s: (int(q // have[s]), q % have[s]) for s, q in quotas.items() if have.get(s)}
    if not plan:
        return sized.where("false").select("doc_id", "source", "n_tokens", F.lit(1).alias("repeats"))
    spark = documents.sparkSession
    planned = F.broadcast(spark.createDataFrame([(s, w, f) for s, (w, f) in plan.items()], "source string, _whole int, _fraction double"))
    bits = BINS.bit_length() - 1
    cuts = planned.select("source", "_fraction", F.lit(0).cast("bigint").alias("_cut"), F.lit(0).cast("bigint").alias("_below"))
    for level in range(1, LEVELS + 1):
        inside = sized.join(F.broadcast(cuts), "source")  # one row per source
        if level > 1:
            inside = inside.where(F.shiftrightunsigned("_h", 64 - (level - 1) * bits) == F.col("_cut"))
        bins = inside.groupBy("source", F.shiftrightunsigned("_h", 64 - level * bits).alias("_bin")).agg(F.sum("n_tokens").alias("_n"), F.first("_fraction").alias("_fraction"), F.first("_below").alias("_from"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = bins.withColumn("_next", F.col("_from") + before).where("_next <= _fraction and _fraction < _next + _n")
        cuts = staged(reached.select("source", "_fraction", F.col("_bin").alias("_cut"), F.col("_next").alias("_below")))
    at = sized.join(planned.drop("_fraction"), "source").join(F.broadcast(cuts), "source", "left").withColumn("_bin", F.shiftrightunsigned("_h", 64 - LEVELS * bits))
    order = Window.partitionBy("source").orderBy("_h", "doc_id")
    last = at.where("_bin = _cut").withColumn("_upto", F.col("_below") + F.sum("n_tokens").over(order)).where("_upto <= _fraction").groupBy("source").agg(F.max(F.struct("_h", "doc_id")).alias("_last"))
    chosen = at.join(F.broadcast(last), "source", "left")  # one row per source
    in_fraction = (F.col("_bin") < F.col("_cut")) | ((F.col("_bin") == F.col("_cut")) & (F.struct("_h", "doc_id") <= F.col("_last")))
    repeats = F.col("_whole") + F.coalesce(in_fraction, F.lit(False)).cast("int")
    return chosen.select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def mixture_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: its target and actual share of all tokens, documents used, tokens with repeats, and the
    greatest repeats."""
    used = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    every = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return wanted.join(used, "source", "left").select(
        "source",
        "target_share",
        F.round(F.coalesce(F.col("n_tokens") / every, F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
