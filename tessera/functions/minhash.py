"""Least hashes of word shingles, whole texts at a time: a column for SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

#: Hashes are taken modulo 2^31 - 1, so that a remainder is a sum of two parts of a number.
PRIME = (1 << 31) - 1

#: Shingles that meet all functions at once, so that the products stay in the processor's cache.
AT_ONCE = 512


def shingles(text: str, k: int) -> Iterator[bytes]:
    """All runs of ``k`` words joined by a blank, with repeats; of fewer words the text itself, of none nothing."""
    words = text.encode().split()  # of bytes, at the same six blanks as in SQL
    if len(words) < k:
        return iter([text.encode()] if words else [])
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[: len(words) - k])
    return map(line.__getitem__, map(slice, starts.tolist(), (ends[k - 1 :] - 1).tolist()))


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of ((7919 i + 1) v + 104729 i) mod PRIME over all ``values`` below 2^28, for each i below ``n``."""
    times, plus = np.arange(n)[:, None] * 7919 + 1, np.arange(n)[:, None] * 104729
    out = np.full(n, PRIME, np.uint32)
    for at in range(0, len(values), AT_ONCE):
        x = values[at : at + AT_ONCE] * times
        x += plus
        high = x >> 31
        x &= PRIME
        x += high  # below twice PRIME
        y = x.astype(np.uint32)
        np.minimum(out, np.minimum(y, y - np.uint32(PRIME)).min(1), out)  # the difference of a lesser one goes round and is larger
    return out.astype(np.int64)


def _least_hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    sha = hashlib.sha256
    for batch in texts:
        out = []
        for text in batch:
            found = b"".join([sha(s).digest()[:4] for s in shingles(text, 5)]) if text is not None else b""
            out.append(least(np.frombuffer(found, ">u4").astype(np.int64) >> 4, 64) if found else None)
        yield pd.Series(out)


def _shared(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in pairs:
        sets = [(set(shingles(x or "", 5)), set(shingles(y or "", 5))) for x, y in zip(a, b, strict=True)]
        yield pd.DataFrame({"common": [len(x & y) for x, y in sets], "both_sizes": [len(x) + len(y) for x, y in sets]})


def register(spark: SparkSession) -> None:
    """``least_hashes(text)``, the 64 least hashes of a text's five-word shingles, null where it has none, and ``shared_shingles(text, text)``."""
    ship(spark)
    spark.udf.register("least_hashes", F.pandas_udf(_least_hashes, "array<bigint>"))
    spark.udf.register("shared_shingles", F.pandas_udf(_shared, "struct<common: bigint, both_sizes: bigint>"))
