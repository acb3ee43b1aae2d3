"""Keyword retrieval: BM25 over an inverted index of word tokens."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Query terms used at most.
MAX_TERMS = 24


def keyword_tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters, in lower case; a run of ideographs is one token."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def _plain_letters() -> tuple[str, str]:
    """The letters of the Latin blocks beyond ASCII that are an ASCII letter with marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for block in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(*block)]
    kept = [(c, plain) for c, plain in pairs if plain != c and plain.isascii() and plain.isalpha()]
    return "".join(c for c, _ in kept), "".join(p for _, p in kept)


_MARKED, _PLAIN = _plain_letters()


def folded(text: Column) -> Column:
    """``text`` with accented Latin letters as plain ones and without combining marks."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{Mn}+", "")


def query_terms(query: str) -> list[tuple[str, bool]]:
    """(term, whether it matches as a prefix): distinct terms of a query in order, without single ASCII letters; a term
    with other than ASCII characters matches as a prefix."""
    plain = "".join(c for c in query.translate(str.maketrans(_MARKED, _PLAIN)) if unicodedata.category(c) != "Mn")
    runs = "".join(c if c.isalnum() else " " for c in plain).split()
    kept = dict.fromkeys(t.lower() for t in runs if len(t) > 1 or not (t.isascii() and t.isalpha()))
    return [(t, not t.isascii()) for t in list(kept)[:MAX_TERMS]]


def keyword_documents(documents: DataFrame, columns: list[str]) -> DataFrame:
    """id, length, tokens: the words of all columns (null ones are empty) with diacritics folded, and how many they are."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    return documents.select("id", keyword_tokens(folded(text)).alias("tokens")).withColumn("length", F.size("tokens"))


def bm25(indexed: DataFrame, query: str, every: bool = False, k: int | None = None) -> DataFrame:
    """id, score of the rows that have any query term (all of them with ``every``), higher is better; ``k`` best if given.

    ``indexed`` as from :func:`keyword_documents`, best from an index (see operators.index). It is read twice: once for the
    number of rows, their mean length and the terms' document frequencies, once to score the rows that have a term.
    Nothing is shuffled but the ``k`` best of each task. Ties break by id.
    """
    terms = query_terms(query)
    counts = [_times(t, prefix) for t, prefix in terms]
    totals = indexed.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(c > 0).alias(f"d{i}") for i, c in enumerate(counts)]).first()
    if not terms or not totals["n"]:
        return indexed.select("id", F.lit(0.0).alias("score")).where("false")
    hit = indexed.select("id", "length", F.array(*counts).alias("tf")).where(F.exists("tf", lambda x: x > 0))
    if every:
        hit = hit.where(F.forall("tf", lambda x: x > 0))
    idf = [max(math.log((totals["n"] - totals[f"d{i}"] + 0.5) / (totals[f"d{i}"] + 0.5)), 1e-6) for i in range(len(terms))]
    score = F.lit(0.0)
    for i, w in enumerate(idf):
        f = F.col("tf")[i]
        score = score + F.lit(w) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(totals["mean"])))
    scored = hit.select("id", score.alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k) if k else scored


def _times(term: str, prefix: bool) -> Column:
    """How often a term stands among the tokens."""
    return F.size(F.filter("tokens", lambda w: w.startswith(term) if prefix else w == term))


def fuse(first: DataFrame, second: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (id, rank): id, score, first_rank, second_rank, the ``k`` best."""
    a = first.select("id", F.col("rank").alias("first_rank"))
    b = second.select("id", F.col("rank").alias("second_rank"))
    score = F.coalesce(1 / (constant + F.col("first_rank")), F.lit(0.0)) + F.coalesce(1 / (constant + F.col("second_rank")), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", score.alias("score"), "first_rank", "second_rank").orderBy(F.desc("score"), "id").limit(k)
