"""Ranked lexical search by WAND over shards of documents.

A task turns its documents into shards: for each term that some query holds, a list of (document, impact) in order of
documents, where the impact is what the term adds to the document's score, and the greatest impact of the list. For each
query the lists' cursors move over windows of documents together. In a window, a document can enter the heap only if the
greatest impacts of the lists that hold it sum up to the heap's threshold: these documents are the pivots. A window is
passed over unread where the lists that reach into it can't make up the threshold; others are read for their pivots, and
only those are scored. Shards of a task share their heaps, and heaps of tasks are merged in two steps.

Queries are taken in blocks of bounded size; each block reads the documents twice, once to count and once to search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, whole

#: Terms are runs of bytes that are none of these; capital letters of ASCII are made small.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: UTF-8 bytes of the queries of a block.
BLOCK_BYTES = 4 << 20

#: A shard ends with so many postings or documents; a window holds so many documents.
SHARD_POSTINGS, SHARD_DOCS, WINDOW_DOCS = 2_000_000, 16384, 1024

#: A merge takes the heaps of so many tasks' classes at once.
MERGED = 512

LAST = np.iinfo(np.int64).max


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item; rows of one id are one item."""
    lower = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.filter(F.split(lower, NOT_TERM), lambda t: t != "")
    return items.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.explode(terms).alias("term")).distinct()


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the texts, the index of each term, and the texts' bounds in them."""
    texts = whole(texts)
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_FOLD))
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, folded], 0, texts.offset))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    some = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(some)])[bounds - bounds[0]]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends


def _postings(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of terms of ``vocabulary``, in order of documents, and every document's number of terms."""
    distinct, index, ends = _terms(texts)
    known = pc.fill_null(pc.index_in(distinct.cast(pa.large_string()), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(ends)
    term = known[index] if len(index) else index
    doc = np.repeat(np.arange(len(n)), n)[term >= 0]
    key, tf = np.unique(doc * max(len(vocabulary), 1) + term[term >= 0], return_counts=True)
    return key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), tf.astype(np.int64), n


def term_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and how many documents hold each term of ``vocabulary``. A number a term comes to the driver."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(held.value, pa.large_string())
        df, seen, total = np.zeros(len(terms) + 2, np.int64), 0, 0
        for batch in batches:
            _, term, _, n = _postings(batch.column("text"), terms)
            df[: len(terms)] += np.bincount(term, minlength=len(terms))
            seen, total = seen + int((n > 0).sum()), total + int(n.sum())
        df[-2:] = seen, total
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["i", "n"])

    counts = np.zeros(len(vocabulary) + 2, np.int64)
    for i, n in map_batches(docs.select("text"), run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[i] = n
    return int(counts[-2]), int(counts[-1]), counts[:-2]


class Shard:
    """Lists of (document, impact) by window and term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.n_terms, self.windows = n_terms, -(-n_docs // WINDOW_DOCS)
        order = np.lexsort((doc, term, doc // WINDOW_DOCS))
        self.doc, self.impact = doc[order], impact[order]
        cell = (self.doc // WINDOW_DOCS) * n_terms + term[order]
        self.start = np.searchsorted(cell, np.arange(self.windows * n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)  # the greatest impact of each list
        np.maximum.at(self.most, term, impact)

    def search(self, terms: np.ndarray, threshold: int, found: list[tuple[np.ndarray, np.ndarray]], top: np.ndarray, k: int) -> int:
        """Add the pivots' documents and scores to ``found``; ``top`` holds the best scores so far. Gives the new threshold."""
        most = self.most[terms]
        for window in range(self.windows):
            cell = window * self.n_terms + terms
            first, size = self.start[cell], self.start[cell + 1] - self.start[cell]
            if most[size > 0].sum() < threshold or not size.any():
                continue  # no document of the window can be a pivot
            at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            doc = self.doc[at] - window * WINDOW_DOCS
            bound = np.bincount(doc, weights=np.repeat(most, size), minlength=WINDOW_DOCS)  # sums below 2**53 are exact
            pivots = (bound >= threshold) & (bound > 0)
            read = pivots[doc]
            score = np.bincount(doc[read], weights=self.impact[at[read]], minlength=WINDOW_DOCS).astype(np.int64)
            hits = np.flatnonzero((score >= threshold) & (score > 0))
            if len(hits):
                found.append((hits + window * WINDOW_DOCS, score[hits]))
                top[:] = np.sort(np.concatenate([top, np.partition(score[hits], -k)[-k:] if len(hits) > k else score[hits]]))[-k:]
                threshold = max(threshold, int(top[0]))
        return threshold


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, then least id."""
    return np.lexsort((ids, -scores))[:k]


def search_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """The ``k`` best documents for each item: (item_col, rank int, id_col, score long), whole numbers of 64 bits.

    A term adds w * ((10**9 * tf) div (1000 * tf + 8 * m)), w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 10 + (90 n N)
    div L, for N documents with a term, L terms in all, n of them in the document and df documents that hold the term; an
    item's terms count once. Only scores above 0 are returned; equal scores are in order of id, a null id last. Null and
    empty texts hold no terms and are found by no item; items without terms find nothing. Rows of one item id are one
    item; rows of one document id are ranked one by one. Other columns don't matter. Ids are whole numbers below 2**63 - 1.
    """
    terms = query_terms(items, item_col, item_text)
    size = items.agg(F.sum(F.octet_length(F.col(f"`{item_text}`"))).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for b in range(blocks):
        pairs = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # BLOCK_BYTES of text, about
        found = _search_block(texts, sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1])), k)
        out = found if out is None else out.union(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _search_block(docs: DataFrame, pairs: list, k: int) -> DataFrame:
    """(item, id, score): the heaps of all tasks for the items of ``pairs`` (item, term), merged once."""
    vocabulary = sorted({t for _, t in pairs})
    place = {t: i for i, t in enumerate(vocabulary)}
    asked: dict = {}
    for item, t in pairs:
        asked.setdefault(item, []).append(place[t])
    documents, total, df = term_counts(docs, vocabulary)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, weight, list(asked), [np.array(x) for x in asked.values()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, names, queries = held.value
        terms = pa.array(vocabulary, pa.large_string())
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in names]
        tops, thresholds = np.zeros((len(names), k), np.int64), [0] * len(names)
        parts, ids, postings = [], [], 0

        def close() -> None:
            nonlocal parts, ids, postings
            before = np.cumsum([0, *map(len, ids)])
            doc, term, impact = (np.concatenate(x) for x in zip(*[(d + at, t, i) for (d, t, i), at in zip(parts, before, strict=False)], strict=True))
            every = np.concatenate(ids)
            shard = Shard(doc, term, impact, len(every), len(terms))
            for q, query in enumerate(queries):
                found: list = []
                thresholds[q] = shard.search(query, thresholds[q], found, tops[q], k)
                if found:
                    at = np.concatenate([d for d, _ in found])
                    i, s = np.concatenate([heaps[q][0], every[at]]), np.concatenate([heaps[q][1], *[s for _, s in found]])
                    keep = best(i, s, k)
                    heaps[q] = i[keep], s[keep]
            parts, ids, postings = [], [], 0

        for batch in batches:
            doc, term, tf, n = _postings(batch.column("text"), terms)
            m = 10 + 90 * n * documents // max(total, 1)
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc])) if len(doc) else tf
            parts.append((doc, term, impact))
            ids.append(pc.fill_null(batch.column("id"), LAST).to_numpy(zero_copy_only=False))
            postings += len(doc)
            if postings >= SHARD_POSTINGS or sum(map(len, ids)) >= SHARD_DOCS:
                close()
        if ids:
            close()
        q = np.repeat(np.arange(len(names)), [len(i) for i, _ in heaps])
        i, s = (np.concatenate([h[x] for h in heaps]) if heaps else np.zeros(0, np.int64) for x in (0, 1))
        item = pa.array([names[x] for x in q.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([item, pa.array(i, pa.int64(), mask=i == LAST), pa.array(s, pa.int64())], names=["item", "id", "score"])

    heaps = map_batches(docs, run, "item long, id long, score long").withColumn("class", F.spark_partition_id() % MERGED)
    order = Window.partitionBy("item", "class").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return heaps.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k).select("item", "id", "score")


def op12_wand(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each item of the benchmark."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search_documents(docs, items)
