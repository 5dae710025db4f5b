"""Shards by token count and packing that keeps documents and spans whole. A token here is a white-space word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import cuts, next_fit

from .dialect import Duck, Spark
from .shards import SEQ, _docs, running

#: Tokens that close a shard.
SHARD = 20000


def _lanes(spark: SparkSession, sf_dir: str, keys: list[str], where: str = "true") -> DataFrame:
    sql = running(f"select * from ({_docs(Spark())}) d where {where}", keys, "n").replace("{documents}", "{docs}")
    return spark.sql(sql, docs=spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text", "block_of")


def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document with words, by lane and split: one closes with the document that brings it to 20,000 words."""
    rows = _lanes(spark, sf_dir, ["lane", "split"])
    shards = cuts.closed_shards(rows, ["lane", "split"], SHARD)
    return cuts.in_shards(rows, shards, ["lane", "split"], SHARD).select("doc_id", "lane", "split", "n", "shard", "start")


def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard's documents, words, languages, and a hash of the texts' hashes in order of id: a shard's documents meet, never a lane's."""
    placed = token_shards(spark, sf_dir).alias("p")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    rows = placed.join(docs, "doc_id")
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "hash"))), lambda x: x["hash"]), "")
    sums = rows.groupBy("lane", "split", "shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("tokens"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first_id"), F.sha2(hashes, 256).alias("content_hash"))
    return sums


def _segments(pieces: DataFrame, groups: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*groups, "seq").orderBy("seq_start")).cast("long")


def pack_doc_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents in sequences of 512 words, next-fit: whole where they fit, longer ones in windows from the room that is left.

    Positions of a document go on over its windows; nothing is placed where no room is left.
    """
    docs = spark.sql(_docs(Spark()).replace("{documents}", "{docs}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet")).where("n > 0 and split = 'train'")
    mode = F.when(F.col("n") > SEQ, next_fit.WINDOWS).otherwise(next_fit.WHOLE)
    block = F.coalesce(F.floor(F.col("doc_id") / 1000), F.lit(-1)).cast("long")
    at = next_fit.placed(docs.select("lane", block.alias("block"), F.col("doc_id").alias("order"), F.col("doc_id").alias("id"), "n", mode.alias("mode")), ["lane"], SEQ)
    windows = F.floor((F.col("start") + F.col("n") - 1) / SEQ)
    each = at.select("lane", F.col("id").alias("doc_id"), "n", "start", "seq", F.explode(F.sequence(F.lit(0).cast("long"), windows)).alias("w"))
    lo, hi = F.greatest(F.col("w") * SEQ - F.col("start"), F.lit(0)), F.least((F.col("w") + 1) * SEQ - F.col("start"), F.col("n"))
    pieces = each.select("lane", (F.col("seq") + F.col("w")).alias("seq"), "doc_id", lo.cast("long").alias("tok_start"), hi.cast("long").alias("tok_end"), F.when(F.col("w") == 0, F.col("start")).otherwise(0).cast("long").alias("seq_start"))
    return pieces.withColumn("segment", _segments(pieces, ["lane"]))


def pack_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in sequences of 512 words, next-fit, no assistant turn cut.

    One that is longer gets sequences of its own, filled turn by turn; a turn of another role may be cut at 512 words. One
    with an assistant turn over 512 words is dropped: its row has no sequence. Turns of no conversation are left out; turns
    of one number are one turn, whose words count for the loss if all do.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("role").eqNullSafe("assistant").alias("loss"), F.coalesce(F.expr(Spark().size(Spark().words("text"))), F.lit(0)).alias("n"))
    dealt = turns.where("conv_id is not null and n > 0").groupBy("conv_id", F.coalesce(F.floor(F.col("turn") / 1000), F.lit(-1)).cast("long").alias("block"), "turn").agg(F.sum("n").cast("long").alias("n"), F.every("loss").alias("loss"))
    convs = dealt.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n"), F.max(F.when(F.col("loss"), F.col("n")).otherwise(0)).alias("largest"))
    fits = convs.where(F.col("n") <= SEQ).select("conv_id", "n", F.lit(next_fit.WHOLE).alias("mode"))
    dropped = convs.where((F.col("n") > SEQ) & (F.col("largest") > SEQ))
    long = dealt.join(convs.where((F.col("n") > SEQ) & (F.col("largest") <= SEQ)).select("conv_id"), "conv_id")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SEQ)))
    parts = long.select("conv_id", "block", "turn", "n", cut.alias("part")).select("conv_id", "block", F.struct("turn", "part").alias("order"), F.lit(0).cast("long").alias("id"), F.least(F.lit(SEQ), F.col("n") - F.col("part") * SEQ).alias("n"), F.lit(next_fit.WHOLE).alias("mode"))
    groups = next_fit.placed(parts, ["conv_id"], SEQ).groupBy("conv_id", "seq").agg(F.sum("n").cast("long").alias("n"))
    sealed = groups.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", F.lit(next_fit.SEALED).alias("mode"))
    one = F.lit(0).alias("lane")
    docs = fits.union(sealed).select(one, F.floor(F.col("conv_id") / 1000).alias("block"), F.col("conv_id").alias("order"), F.col("conv_id").alias("id"), "n", "mode")
    at = next_fit.placed(docs, ["lane"], SEQ).select(F.col("id").alias("conv_id"), "seq", "start", "mode", "n")
    wholes = at.where(F.col("mode") == next_fit.WHOLE).select("seq", "conv_id", F.lit(0).cast("long").alias("tok_start"), F.col("n").cast("long").alias("tok_end"), F.col("start").cast("long").alias("seq_start"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    spread = groups.select("conv_id", F.col("seq").alias("g"), "n", before.cast("long").alias("tok_end")).join(at.where(F.col("mode") == next_fit.SEALED).select("conv_id", "seq"), "conv_id")
    alone = spread.select((F.col("seq") + F.col("g")).alias("seq"), "conv_id", (F.col("tok_end") - F.col("n")).alias("tok_start"), "tok_end", F.lit(0).cast("long").alias("seq_start"))
    pieces = wholes.union(alone)
    kept = pieces.withColumn("segment", _segments(pieces, []))
    return kept.union(dropped.select(F.lit(None).cast("long"), "conv_id", F.lit(0).cast("long"), "n", F.lit(None).cast("long"), F.lit(None).cast("long")))


PACKING_QUERIES: dict = {f.__name__: f for f in (token_shards, shard_manifest, pack_doc_aligned, pack_atomic)}

_DOCS = _docs(Duck()).replace("{documents}", "documents")
_SHARDS = f"""docs as materialized (select doc_id, lane, split, n, row_number() over (partition by lane, split order by doc_id) as i from ({_DOCS}) d where n > 0),
    walk as (select lane, split, i, doc_id, n, cast(0 as bigint) as shard, cast(0 as bigint) as start, n as filled from docs where i = 1
        union all select d.lane, d.split, d.i, d.doc_id, d.n, case when w.filled >= {SHARD} then w.shard + 1 else w.shard end, case when w.filled >= {SHARD} then 0 else w.filled end, case when w.filled >= {SHARD} then d.n else w.filled + d.n end
        from walk w join docs d on d.i = w.i + 1 and d.split = w.split and d.lane is not distinct from w.lane)"""
_PIECES = f"""pieces as (select lane, doc_id, n, seq, start, unnest(range(cast((start + n - 1) // {SEQ} as bigint) + 1)) as w from walk),
    spread as (select lane, seq + w as seq, doc_id, greatest(w * {SEQ} - start, 0) as tok_start, least((w + 1) * {SEQ} - start, n) as tok_end, case when w = 0 then start else 0 end as seq_start from pieces)"""
_OVER = f"case when d.n <= {SEQ} and w.taken + d.n > {SEQ} then 1 else 0 end"
_TURNS = f"select conv_id, turn, {Duck().size(Duck().words('text'))} as n, coalesce(role = 'assistant', false) as loss from conversations where conv_id is not null"
PACKING_SQL: dict[str, str] = {
    "token_shards": f"with recursive {_SHARDS} select doc_id, lane, split, n, shard, start from walk",
    "shard_manifest": f"with recursive {_SHARDS} select w.lane, w.split, w.shard, count(*) as docs, cast(sum(w.n) as bigint) as tokens, count(distinct d.lang) as langs, min(w.doc_id) as first_id, sha256(string_agg(sha256(d.text), '' order by w.doc_id)) as content_hash from walk w join documents d on d.doc_id = w.doc_id group by w.lane, w.split, w.shard",
    "pack_doc_aligned": f"""with recursive docs as materialized (select doc_id, lane, n, row_number() over (partition by lane order by doc_id nulls first) as i from ({_DOCS}) d where n > 0 and split = 'train'),
    walk as (select lane, i, doc_id, n, cast(0 as bigint) as seq, cast(0 as bigint) as start, n % {SEQ} as taken, n // {SEQ} as closed from docs where i = 1
        union all select lane, i, doc_id, n, seq, start, (start + n) % {SEQ}, seq + (start + n) // {SEQ} from (select d.lane, d.i, d.doc_id, d.n, w.closed + {_OVER} as seq, case when {_OVER} = 1 then 0 else w.taken end as start from walk w join docs d on d.i = w.i + 1 and d.lane is not distinct from w.lane) x),
    {_PIECES} select *, row_number() over (partition by lane, seq order by seq_start) as segment from spread""",
    "pack_atomic": f"""with recursive turns as materialized (select conv_id, turn, cast(sum(n) as bigint) as n, bool_and(loss) as loss from ({_TURNS}) t where n > 0 group by conv_id, turn),
    convs as materialized (select conv_id, cast(sum(n) as bigint) as n, max(case when loss then n else 0 end) > {SEQ} and sum(n) > {SEQ} as gone, sum(n) > {SEQ} as wide from turns group by conv_id),
    parts as materialized (select conv_id, least({SEQ}, n - p * {SEQ}) as n, row_number() over (partition by conv_id order by turn, p) as i from (select t.conv_id, t.turn, t.n, unnest(range(cast((t.n - 1) // {SEQ} as bigint) + 1)) as p from turns t join convs c on c.conv_id = t.conv_id and c.wide and not c.gone) x),
    inner_walk as (select conv_id, i, n, cast(0 as bigint) as g, n as filled from parts where i = 1 union all select d.conv_id, d.i, d.n, case when w.filled + d.n > {SEQ} then w.g + 1 else w.g end, case when w.filled + d.n > {SEQ} then d.n else w.filled + d.n end from inner_walk w join parts d on d.conv_id = w.conv_id and d.i = w.i + 1),
    filled as materialized (select conv_id, g, cast(sum(n) as bigint) as n from inner_walk group by conv_id, g),
    docs as materialized (select conv_id, n, m, row_number() over (order by conv_id) as i from (select conv_id, n, cast(0 as bigint) as m from convs where not wide union all select conv_id, 0, count(*) from filled group by conv_id) x),
    walk as (select i, conv_id, n, m, cast(0 as bigint) as seq, cast(0 as bigint) as start, n % {SEQ} as taken, n // {SEQ} + m as closed from docs where i = 1
        union all select i, conv_id, n, m, seq, start, (start + n) % {SEQ}, seq + (start + n) // {SEQ} + m from (select d.*, w.closed + case when (d.m > 0 and w.taken > 0) or w.taken + d.n > {SEQ} then 1 else 0 end as seq, case when d.m > 0 or w.taken + d.n > {SEQ} then 0 else w.taken end as start from walk w join docs d on d.i = w.i + 1) x),
    spread as (select seq, conv_id, cast(0 as bigint) as tok_start, n as tok_end, start as seq_start from walk where m = 0
        union all select w.seq + f.g, f.conv_id, cast(sum(f.n) over (partition by f.conv_id order by f.g) - f.n as bigint), cast(sum(f.n) over (partition by f.conv_id order by f.g) as bigint), 0 from filled f join walk w on w.conv_id = f.conv_id and w.m > 0)
    select *, row_number() over (partition by seq order by seq_start) as segment from spread union all select null, conv_id, 0, n, null, null from convs where gone""",
}
