"""Near-duplicate records with small edits: MinHash banding with exact verification.

1. Every text becomes the set of its word n-grams (64-bit hashes), and the set a *class*: texts with the same set are
   copies of each other and go on as one representative, however many there are.
2. A class gets ``bands * rows`` MinHash values; the values of a band are hashed to one key. Bands and rows follow from
   the threshold and the recall wanted at it (:func:`choose_bands`).
3. Classes are shuffled on band keys; two classes that share a key are a candidate pair. A task sends each class once,
   so a group of copies that holds a third of all rows does not make a key hot. A key that more than ``BLOCK_CLASSES``
   different classes share (variants of one template) is cut into blocks, and pairs of blocks are spread over the tasks.
4. Candidate pairs are verified on the full n-gram sets of one text of each class.
5. The result is the pairs of classes with the members of each (:func:`similar_classes`); :func:`near_duplicate_pairs`
   expands them to pairs of ids, ids of one class being pairs too, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.pairs import blocks_of, member_pairs
from lorespark.llm.staging import small, staged
from lorespark.llm.words import flat_lists, mix, ngram_sets, windows, word_hashes

#: N-gram hashes that one step of the MinHash loop handles, so that it stays in the processor's cache.
STEP = 1 << 16
#: Classes on one band key that a task pairs up.
BLOCK_CLASSES = 2_000


def choose_bands(threshold: float, recall: float = 0.99, rows: int = 4) -> int:
    """The least number of bands of ``rows`` values with which a pair at ``threshold`` shares a band with probability
    ``recall`` or more."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _signer(n: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    addends = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    schema = pa.schema([("source_table", pa.string()), ("id", pa.string()), ("class_key", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for batch in batches:
                lengths, hashes = flat_lists(batch.column("hashes"))
                grams, owner, _ = windows(lengths, hashes, n)
                order = np.lexsort((grams, owner))
                grams, owner = grams[order], owner[order]
                fresh = np.ones(len(grams), bool)
                fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
                grams, owner = grams[fresh], owner[fresh]
                if not len(grams):
                    continue
                docs, first = np.unique(owner, return_index=True)
                kinds = batch.column("source_table").take(pa.array(docs))
                salt = np.array([hash_of(t) for t in kinds.to_pylist()], np.uint64)
                keys = mix(np.add.reduceat(mix(grams + np.uint64(1)), first) + salt).view(np.int64)
                new = []
                for i, key in enumerate(keys.tolist()):
                    if key not in seen:
                        seen.add(key)
                        new.append(i)
                ends = np.append(first[1:], len(grams))
                band_keys = np.empty((len(new), bands), np.int64)
                done = 0
                while done < len(new):
                    upto, size = done, 0
                    while upto < len(new) and (upto == done or size + ends[new[upto]] - first[new[upto]] <= STEP):
                        size += ends[new[upto]] - first[new[upto]]
                        upto += 1
                    some = new[done:upto]
                    values = np.concatenate([grams[first[i] : ends[i]] for i in some])
                    at = np.cumsum([0] + [ends[i] - first[i] for i in some[:-1]])
                    for b in range(bands):
                        key = np.full(len(some), b + 1, np.uint64)
                        for r in range(rows):
                            j = b * rows + r
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((values * factors[j] + addends[j]) >> np.uint64(24), at))
                        band_keys[done:upto, b] = (key + salt[some]).view(np.int64)
                    done = upto
                sizes = np.zeros(len(docs), np.int64)
                sizes[new] = bands
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(band_keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([kinds, batch.column("id").take(pa.array(docs)), pa.array(keys), lists], schema=schema)

    return sign


def hash_of(name: str) -> int:
    """A stable number of a table name, so that texts of different tables never share a class or a band."""
    out = 1469598103934665603
    for byte in name.encode():
        out = (out ^ byte) * 1099511628211 % (1 << 64)
    return out


def near_duplicate_pairs(texts: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.99, rows: int = 4, seed: int = 7) -> DataFrame:
    """All pairs of different ids of one source_table whose n-gram sets have a Jaccard similarity of ``threshold``.

    ``texts``: source_table, id, text (other columns are ignored). Result: source_table, id_a, id_b with id_a < id_b,
    each pair once. Rows with a null id or source_table, null texts and texts of fewer than ``n`` words are in no pair;
    repeated rows count once (rows of one id are taken to carry one text); an empty table gives an empty result. Whole
    texts are read. A pair at the threshold itself is found with probability ``recall``, a closer one with more; no
    pair below the threshold comes out.
    """
    similar, members = similar_classes(texts, threshold, n, recall, rows, seed)
    pairs = member_pairs(similar, members).select("a.source_table", F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"))
    return pairs.where("id_1 <> id_2").select("source_table", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()


def similar_classes(texts: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.99, rows: int = 4, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar classes (class_a, class_b), each once, and the members of all classes (class_key, source_table, id).

    ``texts`` as for :func:`near_duplicate_pairs`. Nothing here grows with the square of a class.
    """
    bands = choose_bands(threshold, recall, rows)
    texts = texts.select("source_table", "id", "text").where("source_table is not null and id is not null and text is not null")
    signed = staged(
        texts.select("source_table", "id", word_hashes(F.col("text")).alias("hashes")).mapInArrow(
            _signer(n, bands, rows, seed), "source_table string, id string, class_key bigint, bands array<bigint>"
        )
    )
    members = staged(signed.select("class_key", "source_table", "id").distinct())
    once = signed.select("class_key", F.explode("bands").alias("band")).repartition("band").dropDuplicates(["band", "class_key"])
    shared = staged(once.withColumn("_n", F.count("*").over(Window.partitionBy("band"))).where("_n > 1"))
    candidates = staged(_candidates(shared).distinct())

    concerned = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class_key")).distinct()
    representatives = members.join(small(concerned), "class_key").groupBy("class_key").agg(F.min(F.struct("source_table", "id")).alias("_r")).select("class_key", "_r.*")
    concerned_texts = texts.join(small(staged(representatives)), ["source_table", "id"]).select("class_key", word_hashes(F.col("text")).alias("hashes"))
    sets = staged(ngram_sets(concerned_texts, n).dropDuplicates(["class_key"]))
    a = sets.select(F.col("class_key").alias("class_a"), F.col("grams").alias("grams_a"))
    b = sets.select(F.col("class_key").alias("class_b"), F.col("grams").alias("grams_b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    similar = candidates.join(a, "class_a").join(b, "class_b").where(shared >= threshold * (F.size("grams_a") + F.size("grams_b") - shared) - 1e-9)
    return similar.select("class_a", "class_b"), members


def _candidates(shared: DataFrame) -> DataFrame:
    """class_a < class_b for classes that share a band; ``shared``: band, class_key, _n (classes of the band)."""
    few, many = shared.where(F.col("_n") <= BLOCK_CLASSES), shared.where(F.col("_n") > BLOCK_CLASSES)
    pairs = few.select("band", F.col("class_key").alias("class_a")).join(few.select("band", F.col("class_key").alias("class_b")), "band").where("class_a < class_b").select("class_a", "class_b")
    if many.isEmpty():
        return pairs
    blocks = blocks_of(F.col("_n"), BLOCK_CLASSES)
    own = F.pmod("class_key", blocks).cast("int")
    met = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    sent = many.select("band", "class_key", own.alias("_own"), F.inline(met))
    a = sent.where("_own = i").select("band", "i", "j", F.col("class_key").alias("class_1"))
    b = sent.where("_own = j").select("band", "i", "j", F.col("class_key").alias("class_2"))
    met_pairs = a.join(b, ["band", "i", "j"]).where("i < j or class_1 < class_2")
    return pairs.unionByName(met_pairs.select(F.least("class_1", "class_2").alias("class_a"), F.greatest("class_1", "class_2").alias("class_b")))
