"""Next-fit packing of ordered documents, in parallel.

What a run of documents does to a packer depends on one number, how much of the current sequence is taken: a run is a
table from that number to the number after it, and to the sequences closed meanwhile. Tables of blocks of documents are
made side by side, composed over blocks of blocks up to one table a lane, and followed down again from an empty sequence;
then every block knows where it starts, and places its own documents. No task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

from .written import Steps

#: What a document asks for: its n tokens in one piece, in windows from where the sequence stands, or n sequences of its own.
WHOLE, WINDOWS, SEALED = 0, 1, 2

#: Blocks that are composed at once.
FAN = 64


def steps_of(taken, n, mode, length):
    """(tokens taken after it, sequences closed by it, sequences closed before its first token) of one document, for one or many ``taken``.

    A full sequence is closed at once, so 0 <= taken < length.
    """
    over = (taken + n > length) if mode == WHOLE else (taken > 0) & (mode == SEALED)
    start = taken * (1 - over)
    end = start + (0 if mode == SEALED else n)
    return end % length, over + end // length + (n if mode == SEALED else 0), over


def _tables(length: int):
    @F.pandas_udf("struct<to: array<int>, closed: array<bigint>>")
    def run(items: pd.Series) -> pd.DataFrame:
        to, closed = [], []
        for docs in items:
            taken, k = np.arange(length), np.zeros(length, np.int64)
            for d in docs:
                taken, more, _ = steps_of(taken, d["n"], d["mode"], length)
                k = k + more
            to.append(taken.astype(np.int32))
            closed.append(k)
        return pd.DataFrame({"to": to, "closed": closed})

    return run


def _places(length: int):
    @F.pandas_udf("array<struct<seq: bigint, start: int>>")
    def run(items: pd.Series, taken: pd.Series, closed: pd.Series) -> pd.Series:
        out = []
        for docs, c, k in zip(items, taken, closed, strict=True):
            c, k, placed = int(c), int(k), []
            for d in docs:
                after, more, before = steps_of(c, int(d["n"]), int(d["mode"]), length)
                placed.append({"seq": k + int(before), "start": 0 if before else c})
                c, k = after, k + int(more)
            out.append(placed)
        return pd.Series(out)

    return run


def _entries(steps: Steps, tables: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(group, block, taken, closed) with which a packer comes to each block; ``tables`` has (group, block from 0, to, closed)."""
    kids = F.array_sort(F.collect_list(F.struct("block", "to", "closed"))).alias("kids")
    above = F.floor(F.col("block") / FAN).cast("long")
    packs = steps.keep(tables.groupBy(*groups, above.alias("parent")).agg(kids))
    if packs.groupBy(*groups).count().where("count > 1").isEmpty():
        came = packs.select("*", F.lit(0).alias("taken"), F.lit(0).cast("long").alias("closed"))
    else:
        both = "named_struct('to', transform(s.to, c -> x.to[c]), 'closed', zip_with(s.closed, s.to, (k, c) -> k + x.closed[c]))"
        joined = F.expr(f"aggregate(slice(kids, 2, size(kids)), named_struct('to', kids[0].to, 'closed', kids[0].closed), (s, x) -> {both})")
        upper = steps.keep(packs.select(*groups, F.col("parent").alias("block"), joined.alias("t")).select(*groups, "block", "t.*"))
        on = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in groups], F.col("l.parent") == F.col("r.block"))
        came = packs.alias("l").join(_entries(steps, upper, groups).alias("r"), on).select("l.*", "r.taken", "r.closed")
    walk = "named_struct('c', x.to[s.c], 'k', s.k + x.closed[s.c], 'out', concat(s.out, array(named_struct('block', x.block, 'taken', s.c, 'closed', s.k))))"
    out = F.expr(f"aggregate(kids, named_struct('c', taken, 'k', closed, 'out', cast(array() as array<struct<block: bigint, taken: int, closed: bigint>>)), (s, x) -> {walk}, s -> s.out)")
    return came.select(*groups, F.explode(out).alias("e")).select(*groups, "e.*")


def placed(docs: DataFrame, groups: Sequence[str], length: int) -> DataFrame:
    """``docs`` (group, block long, order, n > 0, mode, id) with seq and start: the sequence of its group, from 0, and the place there where it begins.

    Documents of a group are packed by block and, within it, by ``order`` and ``id``; a block is taken by one task. WHOLE
    documents have ``length`` tokens at most. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    steps = Steps(spark, "next-fit")
    least = docs.agg(F.min("block")).first()[0] or 0
    items = F.array_sort(F.collect_list(F.struct("order", "id", F.col("n").cast("int").alias("n"), F.col("mode").cast("int").alias("mode")))).alias("items")
    blocks = steps.keep(docs.groupBy(*groups, (F.col("block") - least).alias("block")).agg(items))
    asked = F.transform("items", lambda d: F.struct(d["n"].alias("n"), d["mode"].alias("mode")))
    tables = steps.keep(blocks.select(*groups, "block", _tables(length)(asked).alias("t")).select(*groups, "block", "t.*"))
    came = steps.keep(_entries(steps, tables, groups))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in groups], F.col("l.block") == F.col("r.block"))
    found = blocks.alias("l").join(came.alias("r"), on).select(*[f"l.{c}" for c in groups], "items", _places(length)(asked, F.col("taken"), F.col("closed")).alias("at"))
    each = found.select(*groups, F.explode(F.arrays_zip("items", "at")).alias("x"))
    return each.select(*groups, "x.items.order", "x.items.id", "x.items.n", "x.items.mode", "x.at.seq", "x.at.start")
