"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

Every unit (a document) should be taken ``target / source size`` times. The whole part is fixed; the fraction is a
probability. Pivotal rounding pairs two units of a source and moves mass (probability times size) between them at random,
without changing either's expectation, until one of them is 0 or 1. Blocks of about BLOCK units of a source fold to one
open unit each, blocks of open units fold again, and so on: a reduction tree whose last unit is drawn by itself. A
source's taken mass therefore misses its target by less than one unit. A fold goes from large units to small ones, for a
large one that is open to the end would miss by more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

BLOCK = 128


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) to targets: ``share`` of all sizes dealt out by weight, a source getting ``most`` times its size at most.

    Sources in order of code points, null last, weigh ``weights`` in turn. What capped sources leave goes to the others
    by weight until none is above its cap, so a target is min(most * size, level * weight) for one level. The table has
    one row for each source; only that one is put in order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(turn, (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumns({"cap": F.col("source_size") * float(most), "total": F.sum("source_size").over(Window.partitionBy()) * float(share)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(Window.partitionBy())
    return levels.withColumn("fit", fits["level"]).select("source", "source_size", F.coalesce(F.least("cap", F.col("fit") * F.col("weight")), F.col("cap")).alias("target"))


def _chance(*parts: str) -> str:
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) / 9007199254740992D)"


def _fold(units: DataFrame, seed: int, level: int) -> DataFrame:
    """Units (source, block, u: key, p, size) to (source, block, open unit, settled units with p 0 or 1).

    The fold carries one open unit; with the next one it moves mass either way until one of both is whole.
    """
    state = "named_struct('open', cast(null as struct<key: bigint, p: double, size: double>), 'done', cast(array() as array<struct<key: bigint, p: double>>))"
    # up: mass that a can take from b; down: mass that a can give to b
    up = "least((1D - a.p) * a.size, b.p * b.size)"
    down = "least(a.p * a.size, (1D - b.p) * b.size)"
    takes = f"{_chance(str(seed), str(level), 'a.key', 'b.key')} * (m.up + m.down) < m.down"
    # after a takes: either a is 1, b is open, or b is 0, a is open; and the other way round
    step = f"""
    case when s.open is null then named_struct('open', b, 'done', s.done)
    else element_at(transform(array(named_struct('a', s.open, 'b', b)), x -> element_at(transform(array(named_struct('a', x.a, 'b', x.b,
        'up', {up.replace("a.", "x.a.").replace("b.", "x.b.")}, 'down', {down.replace("a.", "x.a.").replace("b.", "x.b.")})), m ->
        case when {takes.replace("a.key", "m.a.key").replace("b.key", "m.b.key")}
        then case when (1D - m.a.p) * m.a.size <= m.b.p * m.b.size
             then named_struct('open', named_struct('key', m.b.key, 'p', m.b.p - m.up / m.b.size, 'size', m.b.size), 'done', concat(s.done, array(named_struct('key', m.a.key, 'p', 1D))))
             else named_struct('open', named_struct('key', m.a.key, 'p', m.a.p + m.up / m.a.size, 'size', m.a.size), 'done', concat(s.done, array(named_struct('key', m.b.key, 'p', 0D)))) end
        else case when m.a.p * m.a.size <= (1D - m.b.p) * m.b.size
             then named_struct('open', named_struct('key', m.b.key, 'p', m.b.p + m.down / m.b.size, 'size', m.b.size), 'done', concat(s.done, array(named_struct('key', m.a.key, 'p', 0D))))
             else named_struct('open', named_struct('key', m.a.key, 'p', m.a.p - m.down / m.a.size, 'size', m.a.size), 'done', concat(s.done, array(named_struct('key', m.b.key, 'p', 1D)))) end end), 1)), 1) end"""
    lists = units.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), F.xxhash64(F.lit(seed), "key").alias("h"), "key", "p", "size"))).alias("u"))
    plain = "transform(u, x -> named_struct('key', x.key, 'p', x.p, 'size', x.size))"
    return lists.select("source", "block", F.expr(f"aggregate({plain}, {state}, (s, b) -> {step})").alias("f")).select("source", "block", "f.open", "f.done")


def pivotal(units: DataFrame, seed: int = 0) -> DataFrame:
    """Round the units (source, key long, p in (0, 1), size > 0; keys unique) to (key, taken 0 or 1).

    Each unit is taken with probability p, and a source's sum of size * taken misses its sum of size * p by less than
    its largest size. Equal input gives equal results, however it is partitioned.
    """
    counts = saved(units.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n")))
    blocked = units.join(counts, F.col("source").eqNullSafe(F.col("of"))).select("source", "key", "p", "size", F.col("n").alias("all"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("all") / BLOCK)).cast("long")
    now = blocked.select("source", F.pmod(F.xxhash64(F.lit(seed), F.lit(0), "key"), blocks).alias("block"), "key", "p", "size", blocks.alias("blocks"))
    most = counts.agg(F.max("n")).first()[0] or 0
    done, level = None, 0
    while True:
        folded = saved(_fold(now, seed, level).select("source", "block", "open", "done"))
        settled = folded.select(F.explode("done").alias("d")).select("d.key", F.col("d.p").cast("int").alias("taken"))
        done = settled if done is None else done.union(settled)
        opened = folded.where("open is not null").select("source", "block", "open.*")
        if most <= BLOCK:
            break
        most, level = math.ceil(most / BLOCK), level + 1
        now = opened.select("source", F.floor(F.col("block") / BLOCK).alias("block"), "key", "p", "size")
    last = opened.select("key", F.expr(f"cast({_chance(str(seed), '-1', 'key')} < p as int)").alias("taken"))
    return done.union(last)


def mix_sources(df: DataFrame, id_col: str, source_col: str, size: Column, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """How often a mix takes each row: (id, source, size, source_size, target, copies int from 0 to ceil(most)).

    ``size`` is a whole number, 0 for null. Targets are those of source_targets. A null source is a source of its own; a
    source of size 0 has target 0 and its rows 0 copies, as have rows of size 0 in any source. Rows with equal id, source
    and size are counted first, so that a repeated row isn't met one by one, and share the copies among them as evenly as
    whole numbers allow. An empty table gives an empty result.
    """
    sized = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"))
    kinds = saved(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    targets = source_targets(kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, share, most)
    targets = saved(targets.withColumnRenamed("source", "s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.when(F.col("size") > 0, F.col("m") * rate).otherwise(0.0)
    units = kinds.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns({"want": whole, "key": F.xxhash64("id", "source", "size")})
    units = units.withColumn("p", F.col("want") - F.floor("want"))
    open_units = units.where("p > 0").select("source", "key", "p", F.col("size").cast("double").alias("size"))
    drawn = pivotal(open_units, seed)
    got = units.join(drawn, "key", "left").withColumn("all", F.floor("want").cast("long") + F.coalesce("taken", F.lit(0)))
    rows = got.select("id", "source", "size", "source_size", "target", "all", "m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("i"))
    copies = F.floor(F.col("all") / F.col("m")) + (F.col("i") <= F.col("all") % F.col("m")).cast("long")
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def op9_pivotal(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 5, 2, 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs, "doc_id", "source", F.regexp_count("text", F.lit(WORD)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
