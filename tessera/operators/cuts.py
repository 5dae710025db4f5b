"""Shards closed by a resetting sum, found by jumping pointers.

A shard takes documents until its tokens reach a target, the crossing document included; the next one starts with what
follows. With the sum of tokens before each document at hand, every document knows where a shard that starts with it
would end: with the document that holds its target-th token. These are pointers from document to document. Following them
from the first document of a lane gives the cuts; doubling them (a pointer's pointer) takes as many rounds as the
logarithm of the shards, and no task sees more of a lane than the documents of one target's length.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .written import Steps


def _same(names: Sequence[str], *more: tuple[str, str]) -> Column:
    """Null-safe equality of ``names`` in tables l and r, and of columns of different names."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names] + [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in more]
    return reduce(lambda a, b: a & b, on)


def _cell(x: Column, target: int) -> Column:
    return F.floor(x / target).cast("long")


def _ends(spans: DataFrame, groups: Sequence[str], target: int) -> DataFrame:
    """(group, lo, end): where a shard that starts at ``lo`` ends, null where its group ends before that."""
    cells = F.explode(F.sequence(_cell(F.col("lo"), target), _cell(F.col("hi") - 1, target)))
    held = spans.select(*groups, "hi", "lo", cells.alias("cell")).select(*groups, "cell", F.greatest("lo", F.col("cell") * target).alias("at"), F.lit(0).alias("kind"), "hi", F.lit(None).cast("long").alias("lo"))
    asked = spans.select(*groups, _cell(F.col("lo") + target - 1, target).alias("cell"), (F.col("lo") + target - 1).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("hi"), "lo")
    near = Window.partitionBy(*groups, "cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = held.union(asked).withColumn("end", F.last("hi", ignorenulls=True).over(near)).where("kind = 1")
    return found.select(*groups, "lo", F.when(F.col("end") > F.col("at"), F.col("end")).alias("end"))


def closed_shards(rows: DataFrame, groups: Sequence[str], target: int) -> DataFrame:
    """(group, shard long, lo, hi) of ``rows`` (group, n, off: sum of n before it in its group, total: of its group).

    Shards of a group are numbered from 0 and cover its tokens without gaps: each is the shortest run of rows from lo on
    with at least ``target`` tokens, the last one what is left. Rows without tokens don't matter; null groups are groups.
    An empty table gives an empty result.
    """
    steps = Steps(rows.sparkSession, "cuts")
    spans = rows.where("n > 0").select(*groups, F.col("off").alias("lo"), (F.col("off") + F.col("n")).alias("hi"))
    totals = rows.where("n > 0").groupBy(*groups).agg(F.max("total").alias("total"))
    ends = steps.keep(_ends(spans, groups, target))
    jumps = steps.keep(ends.where("end is not null").alias("l").join(totals.alias("r"), _same(groups)).where("end < total").select("l.*"))
    first = jumps
    reached = steps.keep(totals.select(*groups, F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("shard")))
    far = 1
    while True:
        new = steps.keep(reached.alias("l").join(jumps.alias("r"), _same(groups, ("lo", "lo"))).select(*[f"l.{c}" for c in groups], F.col("end").alias("lo"), (F.col("shard") + far).alias("shard")))
        if new.isEmpty():
            break
        grown = steps.keep(reached.union(new))
        doubled = steps.keep(jumps.alias("l").join(jumps.alias("r"), _same(groups, ("end", "lo"))).select(*[f"l.{c}" for c in groups], F.col("l.lo").alias("lo"), F.col("r.end").alias("end")))
        steps.drop(new, reached, *([] if jumps is first else [jumps]))
        reached, jumps, far = grown, doubled, 2 * far
    cuts = reached.alias("l").join(ends.alias("r"), _same(groups, ("lo", "lo"))).select("l.*", "end")
    return cuts.alias("l").join(totals.alias("r"), _same(groups)).select(*[f"l.{c}" for c in groups], "shard", "lo", F.coalesce("end", "total").alias("hi"))


def in_shards(rows: DataFrame, shards: DataFrame, groups: Sequence[str], target: int) -> DataFrame:
    """``rows`` with tokens, and for each its shard and ``start``, its place there. Both sides meet by stretches of ``target`` tokens."""
    cells = shards.select("*", F.explode(F.sequence(_cell(F.col("lo"), target), _cell(F.col("hi") - 1, target))).alias("cell"))
    dealt = rows.where("n > 0").withColumn("cell", _cell(F.col("off"), target))
    met = dealt.alias("l").join(cells.alias("r"), _same([*groups, "cell"]) & (F.col("off") >= F.col("lo")) & (F.col("off") < F.col("hi")))
    return met.select(*[f"l.{c}" for c in rows.columns], "shard", (F.col("off") - F.col("lo")).alias("start"))
