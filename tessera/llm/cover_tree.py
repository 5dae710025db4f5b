"""Embedding near-duplicates: exact cosine-threshold links by dual traversal of cover trees.

Equal vectors of a label are one node first. A label's nodes are dealt by hash into blocks of about BLOCK, and each pair of
blocks is a task of its own, so a hot label spreads. In a task each block becomes a cover tree: nested levels whose radii
halve, a child's centre within its parent's radius, centres of a level farther apart than its radius. Pairs of tree nodes
are followed down together, and dropped as soon as their centres are farther apart than the threshold plus both covering
radii; what is left at the leaves is compared by cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, saved

BLOCK, LEAF = 1024, 8


@dataclass
class Tree:
    centre: int
    radius: float  # the greatest distance of a member from the centre
    members: np.ndarray
    children: list[Tree]


def build(apart: np.ndarray, members: np.ndarray, centre: int, level: float) -> Tree:
    """The tree over ``members`` with ``centre`` at radius ``level``; each child level has half the radius. ``apart``: all distances."""
    node = Tree(centre, float(apart[centre, members].max(initial=0.0)), members, [])
    if len(members) <= LEAF or node.radius == 0:
        return node
    while level / 2 >= node.radius:
        level /= 2
    half, rest, at = level / 2, members, centre
    while len(rest):  # the parent's centre is the first child's; then the first member that none covers
        near = apart[at, rest] <= half
        node.children.append(build(apart, rest[near], at, half))
        rest = rest[~near]
        at = int(rest[0]) if len(rest) else -1
    return node


def tree_of(points: np.ndarray) -> Tree:
    """The tree of a block of unit vectors. Their distances are one matrix product: a block's size is bounded."""
    apart = np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))
    np.fill_diagonal(apart, 0)
    return build(apart, np.arange(len(points)), 0, 2.0)


def dual(a: Tree, b: Tree, x: np.ndarray, y: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members (of x under a, of y under b) that the bounds can't rule out."""
    stack = [([a], [b])]
    while stack:
        left, right = stack.pop()
        cx, cy = x[[n.centre for n in left]], y[[n.centre for n in right]]
        gap = np.sqrt(np.maximum(2 - 2 * cx @ cy.T, 0))
        near = gap <= reach + np.array([n.radius for n in left])[:, None] + np.array([n.radius for n in right])
        for i, j in zip(*np.nonzero(near), strict=True):
            p, q = left[i], right[j]
            if not p.children and not q.children:
                yield np.repeat(p.members, len(q.members)), np.tile(q.members, len(p.members))
            else:
                stack.append((p.children or [p], q.children or [q]))


def links_between(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y with cosine >= threshold; within one block (``same``) each pair once."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    ux, uy = x / nx[:, None], y / ny[:, None]
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7
    ta = tree_of(ux)
    found = list(dual(ta, ta if same else tree_of(uy), ux, uy, reach))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = (np.concatenate(z) for z in zip(*found, strict=True))
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    good = (x[i] * y[j]).sum(1) / (nx[i] * ny[j]) >= threshold
    return i[good], j[good]


def _nodes(df: DataFrame) -> DataFrame:
    """(id, label, vec) to (id, label, node, vec): node a digest of label and vector, null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, raw = [], []
            for label, v in zip(b.column("label").to_pylist(), b.column("vec").to_pylist(), strict=True):
                ok = label is not None and v and None not in v
                a = np.array(v, np.float64) + 0.0 if ok else np.zeros(0)
                ok = ok and bool(np.isfinite(a).all()) and bool(a.any())
                if ok and not 1e-100 < np.abs(a).max() < 1e100:  # squares would leave the range of doubles: the same direction, by a power of two
                    a = np.ldexp(a, -int(np.frexp(np.abs(a).max())[1])) + 0.0
                data = a.tobytes() if ok else None
                nodes.append(hashlib.sha256(f"{label};".encode() + data).digest()[:16] if ok else None)
                raw.append(data)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(nodes, pa.binary()), pa.array(raw, pa.binary())], names=["id", "label", "node", "vec"])

    return map_batches(df, run, "id long, label string, node binary, vec binary")


def _edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """(label, node, vec) to links (a, b) between nodes of one label and one length."""
    sizes = saved(nodes.groupBy("label", F.length("vec").alias("bytes")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    dealt = nodes.withColumn("bytes", F.length("vec")).join(sizes, ["label", "bytes"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.select("label", "bytes", "node", "vec", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def run(table: pa.Table) -> pa.Table:
        first = table.column("i")[0].as_py()
        same = first == table.column("j")[0].as_py()
        table = table.sort_by("node")
        own = table.column("own").to_numpy() == first
        ids = np.array(table.column("node").to_pylist(), object)
        vec = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(len(ids), -1)
        x, y = (own, own) if same else (own, ~own)
        if not x.any() or not y.any():
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        i, j = links_between(vec[x], vec[y], threshold, same)
        return pa.table({"a": pa.array(ids[x][i].tolist(), pa.binary()), "b": pa.array(ids[y][j].tolist(), pa.binary())})

    return pairs.groupBy("label", "bytes", "i", "j").applyInArrow(run, "a binary, b binary")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """A row for each row of ``df``: id, n_links (other rows linked directly), component_id (least id reachable), kept.

    Rows link when labels are equal and not null and the cosine in double precision is ``threshold`` (above 0) or more.
    Null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of unequal
    length don't link. Components of any size are allowed: very large or small vectors are scaled first. Repeated rows link with each other. An unlinked row is its own component. Extra columns are left out.
    """
    rows = saved(_nodes(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))))
    nodes = saved(rows.where("node is not null").groupBy("label", "node").agg(F.first("vec").alias("vec"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    edges = saved(_edges(nodes.select("label", "node", "vec"), threshold).distinct())
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("beside")).withColumnRenamed("a", "node")
    joined = components(edges).withColumnRenamed("id", "node")
    known = nodes.select("node", "rep", "n").join(beside, "node", "left").join(joined, "node", "left")
    known = saved(known.select("node", "rep", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    least = saved(known.groupBy("component").agg(F.min("rep").alias("component_id")))
    of = saved(known.join(least, "component").select("node", "n_links", "component_id"))
    out = rows.select("id", "node").join(of, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_cover_tree(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
