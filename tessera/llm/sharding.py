"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0 to len(weights) - 1) that wins ``key``; a null key counts as a key of its own.

    Shard i scores -ln(u) / weight with u a hash of (seed, i, key) in (0, 1); the least score wins, ties go to the
    lower shard. A new shard changes no other shard's score, so it only takes keys into itself. Shards of weight 0
    get nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("some weight must be above 0")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))

    def score(i: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), text), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("s"), F.lit(i).alias("i"))

    return F.array_min(F.array(*[score(i, w) for i, w in enumerate(weights) if w > 0]))["i"]


def shard_records(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, seed: int = 0, slots: bool = True) -> DataFrame:
    """``df`` with ``shard`` int, ``grown_shard`` int (the shard under the weights ``grown``) and ``slot`` long.

    Slots number each shard's records from 0 without gaps; they are counted per input partition and offset by a small
    table, so a shard never meets in one task. Columns of ``df`` with these names are replaced. An empty table gives
    an empty result; repeated keys share a shard and get slots of their own.
    """
    out = df.drop("shard", "grown_shard", "slot").withColumn("shard", rendezvous(F.col(f"`{key}`"), weights, seed).cast("int"))
    out = out.withColumn("grown_shard", rendezvous(F.col(f"`{key}`"), grown, seed).cast("int") if grown else F.lit(None).cast("int"))
    return numbered(out, ["shard"], "slot") if slots else out


def op2_rendezvous(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """Every document's shard of 40, and of 41."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_records(narrow, "doc_id", [1.0] * shards, [1.0] * (shards + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
