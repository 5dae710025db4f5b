"""Best-fit packing with conflicts: residual-ordered bins that carry bitmaps of their sources and duplicate clusters.

Documents are dealt by hash into groups of about GROUP pieces, so no group grows with the table, and each group is packed
by itself, largest pieces first. A bin is open at a residual; the search starts at the least residual that holds the piece
and goes on to its successors until a bin is found that has no piece of the same duplicate cluster and fewer than
``per_source`` of the same source. Only if no open bin will do is a new one opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import WORD

GROUP = 2048
OUT = "doc_id long, piece int, start_word long, n_words long, bin long, slot int, offset long"


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, per_source: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, source bit, cluster bit) in packing order to (index, bin, slot, offset).

    Bins are (residual, bin) in order. A bin's source bitmap holds the sources that it can take no more of.
    """
    bins: list[tuple[int, int]] = []
    full_sources: list[int] = []
    clusters: list[int] = []
    counts: list[dict[int, int]] = []
    slots: list[int] = []
    for i, (size, source, cluster) in enumerate(pieces):
        at = bisect_left(bins, (size, -1))
        while at < len(bins):
            b = bins[at][1]
            if not (full_sources[b] >> source & 1 or clusters[b] >> cluster & 1):
                break
            at += 1
        if at < len(bins):
            left, b = bins.pop(at)
        else:
            left, b = capacity, len(slots)
            full_sources.append(0), clusters.append(0), counts.append({}), slots.append(0)
        yield i, b, slots[b], capacity - left
        slots[b] += 1
        counts[b][source] = counts[b].get(source, 0) + 1
        if counts[b][source] >= per_source:
            full_sources[b] |= 1 << source
        clusters[b] |= 1 << cluster
        if left > size:
            insort(bins, (left - size, b))


def pack(df: DataFrame, id_col: str, size: Column, source_col: str, cluster: Column, capacity: int = 2048, per_source: int = 2) -> DataFrame:
    """Each row of ``df`` as pieces of ``capacity`` units at most, with the bin, slot and offset of each piece.

    Full pieces of a long document are bins by themselves; its rest is packed. Bins have no overflow and no two pieces of
    one cluster, and at most ``per_source`` of one source. A null or negative size counts as 0 and gives one empty piece;
    null sources are one source, null clusters conflict with nothing. Repeated rows are packed apart, as a cluster's
    members are. Bin numbers are group * 2^32 + number; equal input gives equal bins, however it is partitioned.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("size"), F.col(f"`{source_col}`").cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    groups = max(1, -(-rows.count() // GROUP))
    ship(df.sparkSession)
    pieces = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "size", "source", "cluster"), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["doc_id", "size", "source", "cluster", "group"]).to_pylist(), key=lambda r: (-(r["size"] % capacity if r["size"] else 0), r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["source"] or "", r["cluster"] or ""))
        sources: dict[str | None, int] = {}
        clusters: dict[object, int] = {}
        out, rest = [], []
        top = 0
        base = (table.column("group")[0].as_py() if len(table) else 0) << 32
        for n, r in enumerate(rows):
            whole_pieces = r["size"] // capacity
            for k in range(whole_pieces):
                out.append((r["doc_id"], k, k * capacity, capacity, base + (1 << 31) + top, 0, 0))
                top += 1
            if r["size"] % capacity or not r["size"]:
                c = r["cluster"] if r["cluster"] is not None else n
                rest.append((r, whole_pieces, (r["size"] - whole_pieces * capacity, sources.setdefault(r["source"], len(sources)), clusters.setdefault(c, len(clusters)))))
        for i, b, slot, offset in best_fit([x[2] for x in rest], capacity, per_source):
            r, k, (size, _, _) = rest[i]
            out.append((r["doc_id"], k, k * capacity, size, base + b, slot, offset))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "piece", "start_word", "n_words", "bin", "slot", "offset"])

    return pieces.groupBy("group").applyInArrow(run, OUT)


def pack_documents(docs: DataFrame, capacity: int = 2048, per_source: int = 2) -> DataFrame:
    """Documents by words; equal texts are a duplicate cluster."""
    cluster = F.when(F.length("text") > 0, F.sha2(F.col("text").cast("binary"), 256))
    return pack(docs, "doc_id", F.regexp_count("text", F.lit(WORD)), "source", cluster, capacity, per_source)


def op7_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents in bins of 2,048 words."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
