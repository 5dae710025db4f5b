"""What the operators share: Arrow word columns, checkpoints, gapless numbering and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: ASCII white space, which separates words.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, send the package to the executors (``ship``), and name a checkpoint folder where none is named.

    That is in the warehouse, which all machines share, or a temporary folder where driver and executors are one process.
    """
    ship(spark)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        own = tempfile.mkdtemp() if context.master.startswith("local[") or context.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table in the shared checkpoint folder and read from there.

    A checkpoint computes its last stage twice, once to count and once to write; a table is written as it is computed. Its
    size is known to what reads it.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    for made in _NOTED:
        made.append(path)
    return out


_NOTED: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of the tables that ``saved`` writes meanwhile."""
    _NOTED.append([])
    try:
        yield _NOTED[-1]
    finally:
        _NOTED.pop()


def deleted(spark: SparkSession, folders: Sequence[str]) -> None:
    context = spark.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, as a table; those that ``make`` saved meanwhile are deleted: no one but it could read them."""
    with noted() as made:
        out = saved(make())
    deleted(out.sparkSession, [path for path in made if path != out._table])
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more."""
    for table in tables:
        deleted(table.sparkSession, [table._table])


def held(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, for rows with columns of any name and kind, which a table may not take."""
    prepare(df.sparkSession)
    out = df.checkpoint()
    tidy(df.sparkSession)
    return out


def tidy(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffles, broadcasts and checkpoints of earlier rounds, which wait for a collection."""
    spark.sparkContext._jvm.System.gc()


#: Bits of the filter of ``among``; a power of two. It takes 4 MB, however many keys there are.
FILTER_BITS = 1 << 25


def marked(df: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with boolean ``name``: whether ``column`` may be in ``keys`` (one column of longs). It is false of none that is.

    A bitmap of hashed keys is broadcast, in at most FILTER_BITS / 32768 rows of 4 KB. While keys are few it is true of few
    others; with more keys than bits it is true of most.
    """
    spot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    bits = keys.toDF(column).select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits__"))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("bits__", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("bucket__", F.bitmap_bucket_number(spot)).join(F.broadcast(saved(bits)), "bucket__", "left")
    return met.select(*df.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))


def among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``keys``: all that are, and few others while keys are few; a join decides what is left."""
    return marked(df, column, keys, "may__").where("may__").select(df.columns)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(f, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def whole(texts: pa.Array) -> pa.Array:
    """A text column with nulls made empty, as large strings."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ASCII-white-space words of each text: distinct words, index of each word, offsets of the texts."""
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    some = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat = flat.filter(pa.array(some))
    offsets = np.concatenate([[0], np.cumsum(some)])[bounds - bounds[0]]
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def ragged(offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        yield i, a, b


def numbered(df: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 within each group, in long column ``name``.

    No group meets in one task, however many rows it has: rows are numbered within (group, partition) of a
    checkpointed copy, and offsets come from a table with one row for each group and partition.
    """
    part, base, row = f"{name}__part", f"{name}__base", f"{name}__row"
    kept = held(df.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}))
    keys = [*group, part]
    sums = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.coalesce(F.sum("n").over(sums), F.lit(0)).alias(base))
    within = Window.partitionBy(*keys).orderBy(row)
    rows = kept.withColumn(name, F.row_number().over(within) - 1)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return rows.alias("l").join(offsets.alias("r"), on).select(*[F.col(f"l.`{c}`") for c in rows.columns if c not in (part, row, name)], (F.col(f"l.{name}") + F.col(base)).cast("long").alias(name))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): (id, component), the smallest id of each, by large-star and small-star rounds.

    Both stars link nodes to the least node near them, so edges never outnumber the input's. Each round is written as a
    table and the one before it deleted; rounds grow with the logarithm of the longest path, and end when every node has
    one edge, to a node that has none. Edges (a, a) yield components of one.
    """
    loops = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))  # saved: a hot hub's edges can then be split
        large = saved(both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        near = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = large.join(near.where("n > 1").hint("merge"), "a")
        new = saved(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        loose = new.groupBy("a").count().where("count > 1").select("a").union(new.select(F.col("b").alias("a")).distinct().intersect(new.select("a"))).isEmpty()
        dropped(now, least, large, near)
        now = new
        if loose:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots).union(loops).groupBy("id").agg(F.min("component").alias("component"))
