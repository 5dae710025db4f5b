"""Keep-first selection: a row stays unless an earlier kept row shares a bucket with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import scratch


def keep_first(members: DataFrame) -> DataFrame:
    """``id`` and ``kept_by`` of every id of ``members`` (id, key): null where it is kept, else the least kept id in a bucket of its.

    What one pass over the rows in order of id would give, in rounds: who is least in all its buckets is kept, who shares a
    bucket with a kept one is dropped, the rest waits. Kept rows of a bucket number one at most, so no pairs are made; a
    bucket's minimum is combined before the shuffle. Each round's rest is a written table. Rounds are as many as the
    longest chain in which each row waits for the one before. An empty table gives an empty result.
    """
    spark = members.sparkSession
    folder = scratch(spark, "greedy")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rest, parts, turn = written(members.select("id", "key").distinct(), "0"), [], 0
    while not rest.isEmpty():
        least = rest.groupBy("key").agg(F.min("id").alias("least"))
        kept = written(rest.join(least, "key").groupBy("id").agg(F.every(F.col("id") == F.col("least")).alias("first")).where("first").select("id"), f"kept-{turn}")
        taken = written(rest.join(kept, "id").select("key", F.col("id").alias("by")), f"taken-{turn}")
        gone = rest.join(taken, "key").where("id <> by").groupBy("id").agg(F.min("by").alias("kept_by"))
        gone = written(gone, f"gone-{turn}")
        parts += [kept.select("id", F.lit(None).cast("long").alias("kept_by")), gone]
        turn += 1
        rest = written(rest.join(kept, "id", "left_anti").join(gone, "id", "left_anti"), str(turn))
    out = parts[0] if parts else spark.createDataFrame([], "id long, kept_by long")
    for p in parts[1:]:
        out = out.union(p)
    return out
