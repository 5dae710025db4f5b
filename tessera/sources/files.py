"""Sources and sinks: Parquet trees, JSON lines, lanes of capped bytes, 16-bit binaries."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps checkpoints, else in the warehouse: all machines can read it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parquet_tree(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """All Parquet files below ``root`` with ``file``, their path; ``limit`` rows of them where asked for."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root).withColumn("file", F.col("_metadata.file_path"))
    return rows if limit is None else rows.limit(limit)


def source_of(path: Column) -> Column:
    """The folder that holds a file, without the ending .parquet where that folder is a table."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), r"\.parquet$", "")


def holdout(spark: SparkSession, root: str, column: str = "question") -> DataFrame:
    """``question`` (where no file has it, the first column) of every readable Parquet file below ``root``; unreadable files are passed over."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(root)
    return rows.select(F.col(f"`{column if column in rows.columns else rows.columns[0]}`").cast("string").alias("question"))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines: blank lines are skipped and malformed ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``read_json_lines`` drops: the lines themselves."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.withColumn("row", F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})).where("row is null or row.__bad is not null").select("value")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_lanes(df: DataFrame, path: str, lane: str) -> None:
    """JSON lines in one folder for each lane; a hot lane is spread over the partitions that it comes in."""
    df.write.mode("overwrite").partitionBy(lane).json(path)


def read_lane(spark: SparkSession, path: str, schema: str, lanes: Sequence[str] = (), lane: str = "lane", limit: int | None = None) -> DataFrame:
    """Rows of the named lanes (all where none is named): only their folders are read."""
    rows = spark.read.schema(f"{schema}, {lane} string").json(path)
    rows = rows.where(F.col(lane).isin(*lanes)) if lanes else rows
    return rows if limit is None else rows.limit(limit)


def capped(df: DataFrame, lane: str, key: str, text: str, cap: int, least: int = 1) -> DataFrame:
    """Distinct texts of a lane, stripped and without carriage returns, in order of ``key`` until ``cap`` bytes are met, the crossing text included.

    Of equal texts the one of the least key stays; texts below ``least`` characters go. Sums are taken over blocks of a
    thousand keys first: ``key`` must be a whole number.
    """
    rows = df.select(F.col(f"`{lane}`").alias("lane"), F.col(f"`{key}`").cast("long").alias("key"), F.trim(F.replace(F.col(f"`{text}`"), F.lit("\r"), F.lit(""))).alias("text")).where(F.length("text") >= least)
    first = rows.groupBy("lane", "text").agg(F.min("key").alias("key")).withColumn("size", F.octet_length("text").cast("long")).withColumn("block", F.floor(F.col("key") / 1000))
    sums = first.groupBy("lane", "block").agg(F.sum("size").alias("part"))
    before = F.sum("part").over(Window.partitionBy("lane").orderBy("block")) - F.col("part")
    near = sums.withColumn("before", before).where(F.col("before") < cap).drop("part")
    inside = Window.partitionBy("lane", "block").orderBy("key", "text")
    start = F.col("before") + F.sum("size").over(inside) - F.col("size")
    return first.join(near, ["lane", "block"]).withColumn("start", start).where(F.col("start") < cap).select("lane", "key", "text", "start", "size")


def to_uint16(numbers: Column) -> Column:
    """An array of whole numbers below 65,536 as little-endian bytes."""
    digits = F.transform(numbers, lambda x: F.concat(F.lpad(F.hex(x.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(x, 8).bitwiseAND(255)), 2, "0")))
    return F.unhex(F.array_join(digits, ""))


def from_uint16(data: Column) -> Column:
    """The whole numbers of little-endian bytes; the digits are cut once, as a function of each place would be given all of them."""
    digits = F.regexp_extract_all(F.hex(data), F.lit(".{4}"), F.lit(0))
    return F.transform(F.coalesce(digits, F.array().cast("array<string>")), lambda x: F.conv(F.concat(F.substr(x, F.lit(3), F.lit(2)), F.substr(x, F.lit(1), F.lit(2))), 16, 10).cast("int"))


def read_uint16(spark: SparkSession, path: str) -> DataFrame:
    """Binary files as path and numbers, one row a file: shards are bounded when written."""
    return spark.read.format("binaryFile").load(path).select("path", from_uint16(F.col("content")).alias("numbers"))
