"""Hashes that Spark has no expression for, as Arrow functions over whole batches."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRAP = (1 << 64) - 1


def fnv1a64(data: bytes) -> int:
    """FNV-1a over bytes, 64 bits."""
    value = 0xCBF29CE484222325
    for byte in data:
        value = ((value ^ byte) * 0x100000001B3) & _WRAP
    return value


def splitmix64(value: int) -> int:
    """SplitMix64 of an unsigned 64-bit integer."""
    value = (value + 0x9E3779B97F4A7C15) & _WRAP
    value = ((value ^ (value >> 30)) * 0xBF58476D1CE4E5B9) & _WRAP
    value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & _WRAP
    return value ^ (value >> 31)


def signed_dimension(dimensions: int):
    """token -> struct(dim, sign) in a hashed feature space of ``dimensions``; apply it to distinct tokens."""

    @F.pandas_udf("dim int, sign int")
    def project(tokens: pd.Series) -> pd.DataFrame:
        known = tokens.notna().to_numpy()
        hashes = _fnv1a64_all(tokens[known].str.encode("utf-8").to_numpy())
        out = pd.DataFrame({"dim": pd.array([None] * len(tokens), "Int32"), "sign": pd.array([None] * len(tokens), "Int32")})
        with np.errstate(over="ignore"):
            x = hashes + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        out.loc[known, "dim"] = (hashes % np.uint64(dimensions)).astype(np.int32)
        out.loc[known, "sign"] = np.where(x & np.uint64(1), 1, -1).astype(np.int32)
        return out

    return project


def _fnv1a64_all(values: np.ndarray) -> np.ndarray:
    """FNV-1a of many byte strings: one step per place, over all strings that are long enough."""
    lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
    flat = np.frombuffer(b"".join(values), np.uint8)
    starts = np.cumsum(lengths) - lengths
    out = np.full(len(values), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-lengths, kind="stable")
    longer = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    with np.errstate(over="ignore"):
        for at, n in enumerate(longer):  # the n first of the order have a byte at this place
            some = order[:n]
            out[some] = (out[some] ^ flat[starts[some] + at]) * np.uint64(0x100000001B3)
    return out


@F.pandas_udf(T.StringType())
def content_hash(parts: pd.Series, confidence: pd.Series) -> pd.Series:
    """SHA-256 of an entry's content: an array of strings closed by 0x00, then the confidence as 8 little-endian bytes."""
    return pd.Series([hashlib.sha256(b"".join((p or "").encode() + b"\0" for p in (a if a is not None else [])) + struct.pack("<d", 0.0 if pd.isna(c) else c)).hexdigest() for a, c in zip(parts, confidence)], dtype=object)
