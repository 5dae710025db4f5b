"""Which word windows of one set of texts stand in another: rolling hashes find them, the words themselves decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

#: Windows whose hashes are sent to the tasks at once: 8 bytes each.
BLOCK = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` word hashes: sums of words times powers, shifted back to the window's start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * _powers(_INVERSE, n)


def _windows(docs: DataFrame, size: int, wanted: np.ndarray | None) -> DataFrame:
    """(id, start, h) of windows of ``docs`` (id, words: hashes); of all of them, or of those whose hash is in ``wanted``."""
    held = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, hashes = [], [], []
            for i, words in zip(batch.column("id").to_pylist(), batch.column("words"), strict=True):
                h = rolled(words.values.to_numpy(zero_copy_only=False).view(np.uint64), size) if words.is_valid else np.zeros(0, np.uint64)
                at = np.arange(len(h)) if held is None else np.flatnonzero(np.isin(h, held.value))
                ids += [i] * len(at)
                starts.append(at)
                hashes.append(h[at])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*hashes, np.zeros(0, np.uint64)]).view(np.int64))], names=["id", "start", "h"])

    return docs.mapInArrow(run, "id long, start long, h long")


def window_hits(windows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """How often each of ``windows`` (key unique, words: array of ``size`` strings) stands in ``texts`` (id, words): (key, places long, texts long).

    Windows found nowhere have 0. Hashes of BLOCK windows at a time go to the tasks, which send back what meets one; those
    places are compared word by word. Texts of fewer words hold nothing; null texts and an empty table neither.
    """
    ship(texts.sparkSession)
    coded = texts.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    asked = windows.select("key", F.col("words").alias("want"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    hashed = asked.join(_windows(asked.select(F.col("key").alias("id"), F.col("hashes").alias("words")), size, None).select(F.col("id").alias("key"), "h"), "key").select("key", "want", "h")
    blocks = max(1, -(-windows.count() // BLOCK))
    found = None
    for b in range(blocks):
        mine = hashed.where(F.pmod("key", F.lit(blocks)) == b)
        hashes = np.sort(np.array([r["h"] for r in mine.select("h").distinct().toLocalIterator()], np.int64).view(np.uint64))
        met = _windows(coded, size, hashes).join(mine, "h")
        found = met if found is None else found.union(met)
    real = found.alias("f").join(texts.alias("t"), "id").where(F.slice("t.words", F.col("f.start").cast("int") + 1, size) == F.col("f.want"))
    counts = real.groupBy("key").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("id").alias("texts"))
    return windows.select("key").join(counts, "key", "left").select("key", F.coalesce("places", F.lit(0)).cast("long").alias("places"), F.coalesce("texts", F.lit(0)).cast("long").alias("texts"))
