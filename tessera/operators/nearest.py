"""The nearest other vector of queries, by products of blocks: every query against every row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

#: Vectors of a block of queries or rows, and queries that are broadcast at once.
QUERIES, ROWS, PART = 512, 2048, 32768


def _pack(block: int):
    """Rows (id, v) to blocks (ids, size, data) of vectors of one length, in doubles; null vectors and those with a null have size -1 and no data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            nulls = np.zeros(len(v), np.int64)
            np.add.at(nulls, pc.list_parent_indices(v).to_numpy(zero_copy_only=False), pc.is_null(v.flatten()).to_numpy(zero_copy_only=False))
            sizes = np.where(nulls > 0, -1, pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), block):
                    part = at[i : i + block]
                    data = v.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).tobytes() if size > 0 else b""
                    yield pa.RecordBatch.from_pydict({"ids": [ids[part].tobytes()], "size": pa.array([size], pa.int32()), "data": [data]})

    return run


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks to (id, gap, equal) for each query: its least gap (null where no other has its length) and how many are 0, of what the task has seen."""
    found: dict[bytes, list[np.ndarray]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            q_ids, q_size, q_data, ids, size, data = row
            x, y = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
            other = x[:, None] != y[None, :]
            key = b"%d:" % q_size + q_ids
            if key not in found:
                found[key] = [np.full(len(x), np.nan), np.zeros(len(x), np.int64), np.zeros(len(x), bool), np.zeros(len(x), bool)]
            least, equal, some, valid = found[key]
            some |= other.any(1)
            if q_size != size or size < 0:
                continue
            a, c = np.frombuffer(q_data).reshape(len(x), size), np.frombuffer(data).reshape(len(y), size)
            with np.errstate(all="ignore"):
                gap = (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (a @ c.T)
                gap[~other] = np.nan
                np.fmin(least, np.fmin.reduce(gap, 1), out=least)
                equal += (gap <= 1e-9).sum(1)
            valid |= other.any(1)
    for key, (least, equal, some, valid) in found.items():
        x = np.frombuffer(key[key.index(b":") + 1 :], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.array(least[some], mask=~valid[some]), pa.array(equal[some])], names=["id", "gap", "equal"])


def nearest_gaps(rows: DataFrame, queries: Column) -> DataFrame:
    """(id long, v array of doubles) to (id, gap, equal) of those that ``queries`` picks: the least squared distance to a row of another id, and to how many it is 1e-9 at most.

    Lengths that differ and nulls give no distance. Blocks of rows meet all blocks of queries; those are broadcast, PART
    queries at a time, so that memory doesn't grow, and a task keeps one figure for each of them.
    """
    ship(rows.sparkSession)
    schema = "ids binary, size int, data binary"
    rows = rows.where("id is not null")
    asked = rows.where(queries)
    parts = max(1, -(-asked.count() // PART))
    blocks = rows.mapInArrow(_pack(ROWS), schema).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = None
    for i in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) if parts > 1 else asked
        packed = some.mapInArrow(_pack(QUERIES), schema).toDF("q_ids", "q_size", "q_data")
        met = F.broadcast(packed).crossJoin(blocks).mapInArrow(_least, "id long, gap double, equal long")
        out = met if out is None else out.union(met)
    return out.groupBy("id").agg(F.min("gap").alias("gap"), F.sum("equal").alias("equal"))
