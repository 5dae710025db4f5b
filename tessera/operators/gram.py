"""Gram matrices of vectors, summed in the tasks and then by cell, and what follows from one: ridge inverses and minimum-norm recovery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship


def gram(vectors: DataFrame, column: str, size: int) -> tuple[np.ndarray, int]:
    """The sum of x x^T over the vectors of ``size`` finite numbers, and how many there are; others are left out.

    A task sends its sum, ``size`` squared numbers; the same comes to the driver. An empty table gives zeros.
    """
    ship(vectors.sparkSession)
    v = F.col(f"`{column}`").cast("array<double>")
    whole = vectors.select(v.alias("v")).where((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            total += x.T @ x
            n += len(x)
        cells = np.arange(size * size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.append(total.reshape(-1), n))], names=["cell", "x"])

    sums = np.zeros(size * size + 1)
    for cell, x in whole.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        sums[cell] = x
    return sums[:-1].reshape(size, size), int(sums[-1])


def projection(rows: int, size: int) -> np.ndarray:
    """A fixed random matrix, its rows about as long as one."""
    return np.random.default_rng(rows).standard_normal((rows, size)) / np.sqrt(size)


def recovery(total: np.ndarray, rows: int) -> dict[str, float]:
    """What is lost when vectors with Gram matrix ``total`` are recovered from ``rows`` random projections W x by W^T (W W^T)^-1: the share of their squared length, and how ill W W^T is conditioned."""
    w = projection(rows, len(total))
    inner = w @ w.T
    kept = np.trace(np.linalg.solve(inner, w @ total @ w.T))
    length = float(np.trace(total))
    return {"lost": float(1 - kept / length) if length else 0.0, "condition": float(np.linalg.cond(inner))}


def ridge(total: np.ndarray, penalty: float) -> dict[str, float]:
    """Of the ridge inverse (G + penalty I)^-1: the effective number of dimensions, and the condition number of what is inverted."""
    shifted = total + penalty * np.eye(len(total))
    return {"dimensions": float(np.trace(np.linalg.solve(shifted, total))), "condition": float(np.linalg.cond(shifted))}
