"""Byte-pair merges learned from counts of distinct words, one most frequent pair after another.

Words are distinct and counted before, so a merge costs one pass over the vocabulary, however long the texts are. Such a pass
reads the words as numbers of their symbols, in Arrow batches, applies the merges that aren't written yet to all words of a
part at once and counts its pairs; Spark adds the parts' counts up and takes the first pair. Words are written anew after
PENDING merges, so that a pass doesn't grow with their number. The driver holds the merges alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

from .written import Steps

#: Merges that a pass applies before the words are written with them.
PENDING = 32

#: Words that are counted at once, and the most pairs of symbols that are counted by a table.
PART, TABLE = 50_000, 1 << 22

#: Stands before a word, as a space does before words within a text.
MARK = "▁"

#: Symbols are numbered by code point, from 1, and merged ones after them; 0 stands before each word.
FIRST_MERGED = 0x110001


def symbols(word: Column, kind: str) -> Column:
    """The first symbols of a word, as its text: its code points after MARK, or its bytes (written as the code points 0 to 255) after a space."""
    return F.concat(F.lit(MARK), word) if kind == "chars" else F.decode(F.encode(F.concat(F.lit(" "), word), "UTF-8"), "ISO-8859-1")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, n) to (s, n): the numbers of a word's code points, four bytes each."""
    for b in batches:
        texts = b.column(0).to_pylist()
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32) + np.int32(1)
        yield pa.RecordBatch.from_arrays([_binary(codes, np.array([len(t) for t in texts], np.int64)), b.column(1)], ["s", "n"])


def _binary(codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    ends[1:] = np.cumsum(sizes * 4)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes, np.int32))])


def _parts(batches: Iterator[pa.RecordBatch], pending: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The symbols of many words one after another, 0 before each, with ``pending`` merges applied, and the words' counts."""
    held: list[pa.RecordBatch] = []
    for b in _closed(batches):
        if b is not None:
            held.append(b)
        if held and (b is None or sum(x.num_rows for x in held) >= PART):
            words = pa.concat_arrays([x.column(0).cast(pa.large_binary()) for x in held])
            n = np.concatenate([x.column(1).to_numpy(zero_copy_only=False) for x in held])
            held = []
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] // 4
            codes = np.frombuffer(words.buffers()[2], np.int32)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.int32)
            flat = np.zeros(len(codes) + len(words), np.int32)
            flat[np.arange(len(codes)) + np.repeat(np.arange(1, len(words) + 1), np.diff(ends))] = codes
            for merge in pending:
                flat = _merge(flat, *merge)
            yield flat, n


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _merge(flat: np.ndarray, a: int, b: int, ab: int) -> np.ndarray:
    """Every a with b after it becomes ab, from the left."""
    at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b))
    if a == b and len(at):  # of a run every other place
        fresh = np.append(True, np.diff(at) != 1)
        at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
    if not len(at):
        return flat
    keep = np.ones(len(flat), bool)
    keep[at + 1] = False
    out = flat.copy()
    out[at] = ab
    return out[keep]


def _counted(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) of the neighbours within words."""
    times = n[np.cumsum(flat == 0) - 1][1:]
    used = np.flatnonzero(np.bincount(flat))
    place = np.zeros(used[-1] + 1, np.int64)
    place[used] = np.arange(len(used))
    ids, k = place[flat], len(used)
    inside = (flat[:-1] != 0) & (flat[1:] != 0)
    pair, times = (ids[:-1] * k + ids[1:])[inside], times[inside]
    if k * k <= TABLE:
        total = np.bincount(pair, times, k * k)
        found = np.flatnonzero(total)
        total = total[found]
    else:
        found, index = np.unique(pair, return_inverse=True)
        total = np.bincount(index, times, len(found))
    return used[found // k], used[found % k], total.astype(np.int64)


def _pairs(words: DataFrame, pending: list[tuple[int, int, int]], names: dict[int, str]) -> DataFrame:
    """(a, b, n): how often b follows a, as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, n in _parts(batches, pending):
            a, b, total = _counted(flat, n)
            yield pa.RecordBatch.from_arrays([*(pa.array([names.get(i) or chr(i - 1) for i in x.tolist()], pa.string()) for x in (a, b)), pa.array(total)], ["a", "b", "n"])

    return words.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _rewritten(words: DataFrame, pending: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, n in _parts(batches, pending):
            sizes = np.diff(np.append(np.flatnonzero(flat == 0), len(flat))) - 1
            yield pa.RecordBatch.from_arrays([_binary(flat[flat != 0], sizes), pa.array(n)], ["s", "n"])

    return words.mapInArrow(run, "s binary, n long")


def learn_merges(words: DataFrame, merges: int, kind: str = "chars", least: int = 1) -> list[tuple[str, str, int]]:
    """The first ``merges`` merges (left, right, count) of ``words`` (word, n), fewer where no pair is as frequent as ``least``.

    Each merge takes the most frequent pair, of equals the least in order of code points; every neighbouring pair counts, in
    "aaa" two, and a merge goes through a word from the left. Null words are left out; repeated ones add up. An empty table
    gives no merges.
    """
    ship(words.sparkSession)
    steps = Steps(words.sparkSession, "bpe")
    counted = words.where("word is not null and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    now = steps.keep(counted.select(symbols(F.col("word"), kind).alias("text"), "n").mapInArrow(_numbered, "s binary, n long"))
    done: list[tuple[str, str, int]] = []
    number: dict[str, int] = {}  # of merged symbols; equal strings are one symbol, however they were made
    pending: list[tuple[int, int, int]] = []
    while len(done) < merges:
        if len(pending) == PENDING:
            before, now = now, steps.keep(_rewritten(now, pending))
            steps.drop(before)
            pending = []
        top = _pairs(now, pending, {i: s for s, i in number.items()}).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(1).collect()
        if not top:
            break
        a, b, n = top[0]
        done.append((a, b, n))
        one, other = (number.get(s) or ord(s) + 1 for s in (a, b))
        pending.append((one, other, number.setdefault(a + b, FIRST_MERGED + len(number))))
    steps.drop(now)
    return done
