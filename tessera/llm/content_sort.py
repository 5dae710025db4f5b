"""Exact dedup by a content sort, in DataFrame operations alone.

Rows are range-partitioned by splitters that Spark samples of the normalised bytes, and each range is sorted by whole
contents, spilling to disk, so that equal texts become neighbours. A window compares each row's whole text with its
neighbour's and gives runs of equals their least id. Only the order inside a splitter is shortened: it holds the first
bytes and a hash of the text, so that neither a sample nor a splitter grows with the texts. Which texts are equal is never
decided by the hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved, shuffle_parts

#: Bytes of a text in a splitter.
PREFIX = 64

#: A text's copies are dealt out once they have more rows, or more bytes, than these and than a quarter of an even range.
SPLIT_ROWS, SPLIT_BYTES = 256, 4 << 20

#: Runs of white space that aren't one plain space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space made one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def _crowds(rows: DataFrame, parts: int) -> DataFrame:
    """(h, pieces): into how many pieces the copies of hash ``h`` are dealt. A sort of few rows: 8 for each range at most."""
    counts = saved(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    most_rows = max(SPLIT_ROWS, (total["n"] or 0) // (4 * parts))
    most_bytes = max(SPLIT_BYTES, (total["b"] or 0) // (4 * parts))
    pieces = F.greatest(F.ceil(F.col("n") / most_rows), F.ceil(F.col("b") / most_bytes))
    crowds = saved(counts.where((F.col("n") > 1) & ((F.col("n") > most_rows) | (F.col("b") > most_bytes))).select(F.col("h").alias("crowd"), F.least(pieces, "n").alias("pieces")))
    dropped(counts)
    return crowds


def equal_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """For every row: ``id_col``, the columns of ``carry``, keep_id, group_size long, kept boolean, text_sha256 string.

    Texts are equal when their normalised bytes are; null is the empty text, and empty texts are equal. keep_id is the
    least id of the equal rows; nulls come last, and it is null if all are. One row of each group is kept, one with the
    least id: of rows that repeat that id it is any one, the others are dropped. Columns of ``df`` that are not asked for
    don't matter, whatever their names; of ``carry`` none may have a result's name. An empty table gives an empty result.

    Copies of a very common text are dealt by a hash of their ids into pieces, each sorted as a text of its own; what the
    pieces found is then combined, by whole texts again, in one row a piece. A piece's rows find that result by the
    text's SHA-256. All rows with one id stay in one piece.
    """
    taken = {id_col, "keep_id", "group_size", "kept", "text_sha256"}
    if taken & set(carry):
        raise ValueError(f"names of results can't be carried: {sorted(taken & set(carry))}")
    text = normalised(F.col(f"`{text_col}`"))
    parts = shuffle_parts(df)
    crowds = _crowds(df.select(text.alias("t")).select(F.xxhash64("t").alias("h"), F.octet_length("t").cast("long").alias("size")), parts)
    rows = df.select(F.struct(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"), text.alias("t"))
    rows = rows.withColumns({"h": F.xxhash64("t"), "front": F.substring(F.col("t").cast("binary"), 1, PREFIX)})
    rows = rows.join(F.broadcast(crowds), F.col("h") == F.col("crowd"), "left").drop("crowd")  # a row for an eighth of a range at least
    rows = rows.withColumn("piece", F.coalesce(F.pmod(F.xxhash64(F.col("row.id"), F.lit(11)), "pieces"), F.lit(0).cast("long")))
    run = Window.partitionBy("front", "h", "piece", "t").orderBy(F.col("row.id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = rows.repartitionByRange("front", "h", "piece").withColumns(
        {"turn": F.row_number().over(run), "least": F.min("row.id").over(whole), "n": F.count(F.lit(1)).over(whole)}
    )
    first = F.col("turn") == 1
    found = saved(runs.select("row", "least", "n", first.alias("first"), F.sha2("t", 256).alias("sha"), F.when(first & F.col("pieces").isNotNull(), F.col("t")).alias("t")))
    joined = found.where("t is not null").groupBy("t").agg(F.min("least").alias("all_least"), F.sum("n").alias("all_n"))
    joined = joined.select(F.sha2("t", 256).alias("of"), "all_least", "all_n")
    out = found.join(F.broadcast(joined), F.col("sha") == F.col("of"), "left")
    whole_run = F.col("of").isNull()
    keep = F.when(whole_run, F.col("least")).otherwise(F.col("all_least"))
    return out.select(
        F.col("row.id").alias(id_col), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)], keep.alias("keep_id"),
        F.coalesce("all_n", "n").cast("long").alias("group_size"), (F.col("first") & (whole_run | F.col("least").eqNullSafe(F.col("all_least")))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def op11_content_sort(spark, sf_dir: str) -> DataFrame:
    """Which of all documents stay where whole texts are equal, white space aside."""
    return equal_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
