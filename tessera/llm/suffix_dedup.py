"""Suffix-array deduplication: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

A byte goes when a string of ``length`` bytes that covers it also starts earlier. Two windows of that length that are
equal have the same minimiser (the least hash of their KMER-byte strings, leftmost of equals), so windows are dealt out
by minimiser and equal windows always meet:

1. Each text becomes runs of neighbouring windows with one minimiser. A run's bytes are its segment. Runs leave their
   task as packed arrays, one row for each bucket of minimisers, with equal segments of a task reduced to the first.
2. A bucket reduces equal segments again: only the first occurrence stays a candidate, the others are covered. A window
   reaches at least half of what its minimiser's string leaves of it to one side, so where different segments agree in
   these bytes left or right, their windows on that side are sent on.
3. The bytes of these segments are fetched, and each bucket builds the suffix array and the Burrows-Wheeler transform of
   shards of them. The transforms are merged by refining their interleave: each pass sorts the rows stably by their
   transform symbol and follows LF, after which rows are in order of one symbol more; a boundary drawn in pass i is a
   common prefix of i. The blocks without a boundary after ``length`` passes are the repeated intervals; no merged text
   is sorted again. The first window of each interval stays, the others are covered.
4. Covered intervals meet their text again and are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, map_batches, marked, mix64, saved, settled, shuffle_parts

KMER = 24
#: Bytes hashed at once, of one text or several.
CHUNK = 1 << 17
#: Packed runs that a map task holds before it sends them on.
HELD = 2_000_000
#: Segment bytes that a bucket of the merge aims at, and shards in it.
MERGE_BYTES, SHARDS = 1 << 18, 2
#: Of a window of 100, as many bytes at least lie left of its minimiser's string, or else right of it.
RUNS = np.dtype([("f", "<u8"), ("s", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<i8"), ("start", "<i4"), ("n", "u1"), ("lead", "u1")])
WANT = np.dtype([("f", "<u8"), ("start", "<i4"), ("n", "u1")])
HEAD = np.dtype([("f", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "u1")])
_U = np.uint64


def _tables(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


def _powers(m: int, n: int) -> np.ndarray:
    out = np.full(n, m, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_M1, _M2 = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25
_CACHE: dict[int, tuple] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = max(CHUNK + 4096, n)
    if not _CACHE or next(iter(_CACHE)) < size:
        _CACHE.clear()
        _CACHE[size] = tuple(_powers(m, size) for m in (_M1, pow(_M1, -1, 1 << 64), _M2, pow(_M2, -1, 1 << 64)))
    return next(iter(_CACHE.values()))


T1, T2 = _tables(1), _tables(2)


def runs_of(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts buf[starts[i]:ends[i]], the text of each run, and the runs with ``start`` in buf.

    ``lead`` counts the windows that hold ``side`` bytes before the minimiser's string; the others hold them after it.
    """
    n = len(buf)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, RUNS)
    p1, q1, p2, q2 = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(T1[buf] * q1[:n], out=sums[1:])
    h = mix64((sums[KMER:] - sums[:-KMER]) * p1[: n + 1 - KMER])
    key = (h & _U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    wide, have = length - KMER + 1, 1
    least = key
    while have * 2 <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    good = np.zeros(n + 1, np.int8)
    long_enough = ends - starts >= length
    np.add.at(good, starts[long_enough], 1)
    np.add.at(good, ends[long_enough] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(good[: len(least)], dtype=np.int8))
    if not len(at):
        return runs_of(buf[:0], ends[:0], starts[:0], length)
    where = (least[at] & _U(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    begin, count = at[first], np.diff(np.append(first, len(at)))
    sums[1:] = np.cumsum(T2[buf] * q2[:n])
    span = lambda a, b: mix64((sums[b] - sums[a]) * p2[a])
    side, string = (length - KMER) // 2, where[first]
    out = np.zeros(len(first), RUNS)
    out["f"], out["start"], out["n"] = h[string], begin, count
    out["s"] = mix64(span(begin, begin + count - 1 + length) + count.astype(np.uint64))
    out["lead"] = lead = np.clip(string - side - begin + 1, 0, count)
    left, right = lead > 0, lead < count
    out["left"][left] = span(string[left] - side, string[left]) >> _U(48)
    out["right"][right] = span(string[right] + KMER, string[right] + KMER + side) >> _U(48)
    return np.searchsorted(starts, begin, "right") - 1, out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals sorted and joined within each document, where they touch or overlap."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o].astype(np.int64), end[o].astype(np.int64)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    rank = np.cumsum(new) - 1
    span = int(end.max()) + 1
    top = np.maximum.accumulate(end + rank * span) - rank * span
    new[1:] |= start[1:] > top[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], top[np.append(at[1:], len(doc)) - 1]


def _by_doc(kind: int, doc: np.ndarray, body: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc, kind, packed rows) for rows in order of doc."""
    cut = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc)) if len(doc) else np.zeros(1, int)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(doc[a]), kind, body[a:b].tobytes()


def _covers(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    doc, start, end = merged(doc, start, end)
    return _by_doc(0, doc, np.stack([start, end], axis=1).astype("<i4") if len(doc) else np.zeros((0, 2), "<i4"))


def reduce_runs(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order of (minimiser, segment, doc, start), and which are the first of their segment.

    Segments count as equal when minimiser, segment (64 bits each, by unlike tables) and number of windows are.
    """
    o = np.lexsort((runs["start"], runs["doc"], runs["n"], runs["s"], runs["f"]))
    runs = runs[o]
    first = np.ones(len(runs), bool)
    first[1:] = (runs["f"][1:] != runs["f"][:-1]) | (runs["s"][1:] != runs["s"][:-1]) | (runs["n"][1:] != runs["n"][:-1])
    return runs, first


def _shared(runs: np.ndarray, rows: np.ndarray, side: str) -> np.ndarray:
    """Which of ``runs`` are among ``rows`` and agree with another of them in minimiser and ``side``."""
    key = mix64(runs["f"][rows] ^ mix64(runs[side][rows].astype(np.uint64)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    out = np.zeros(len(runs), bool)
    out[rows] = count[inverse] > 1
    return out


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key`` and each place's dense rank."""
    order = np.argsort(key)
    ranked = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return order, rank


def transform(body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, Burrows-Wheeler transform and LF of a shard of strings, each with a terminator after it.

    Symbols of the transform are byte + 1, 0 for a terminator (UTF-8 has no byte 255); positions count terminators.
    Suffixes are sorted by prefix doubling up to their terminators; those that are equal till there stay in order.
    """
    n = len(body) + len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(n + 8, np.uint8)
    inner = np.ones(n, bool)
    inner[ends] = False
    text[:n][inner] = body + np.uint8(1)
    left = np.repeat(ends, sizes + 1) - np.arange(n)  # symbols before the terminator
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << _U(8) | np.where(left > i, text[i : n + i], 0).astype(np.uint64)
    (sa, rank), span = _ranks(key), 8
    while span <= int(sizes.max()):
        on = np.minimum(np.arange(n) + span, n - 1)
        (sa, rank), span = _ranks(rank * (n + 1) + np.where(left >= span, rank[on] + 1, 0)), span * 2
    before = np.arange(-1, n - 1)
    before[ends - sizes] = ends
    rows = np.empty(n, np.int64)
    rows[sa] = np.arange(n)
    back = before[sa]
    return sa, text[back], rows[back]


#: Symbols by which a pass of the refinement goes on.
STRIDE = 8


def interleave(transforms: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge (transform, LF) pairs: rows of the joined shards in order of their first ``depth`` symbols, and block numbers.

    Rows of a block share these symbols. A pass sorts the rows stably by the STRIDE symbols before them, which following
    LF through the transform gives, and moves each row on by as many; the first pass takes what is over.
    """
    shift = np.cumsum([0] + [len(b) for b, _ in transforms])
    symbols = np.concatenate([b for b, _ in transforms])
    lf = np.concatenate([f + s for (_, f), s in zip(transforms, shift[:-1], strict=True)])
    n = len(symbols)
    at = np.arange(n)
    block = np.zeros(n, np.int64)
    plan = [depth % STRIDE] * (depth % STRIDE > 0) + [STRIDE] * (depth // STRIDE)
    ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    bits = max(1, int(n).bit_length())
    mask = (1 << bits) - 1
    new = np.zeros(n, bool)
    for width in plan:
        if width not in ready:
            word, to = np.zeros(n, np.uint64), np.arange(n)
            for i in range(width):
                word |= symbols[to].astype(np.uint64) << _U(8 * i)
                to = lf[to]
            ready[width] = _ranks(word)[1] << bits, to
        word, to = ready[width]
        both = np.sort(word[at] | np.arange(n))  # the place among the rows makes the sort stable
        order, c = both & mask, both >> bits
        block = block[order]
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        at = to[at[order]]
        block = np.cumsum(new)
    return at, block


def _distinct(head: np.ndarray, body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The earliest of each group of equal segments with the bytes of these, and documents and starts of the others' windows."""
    ends = np.cumsum(sizes)
    data = body.tobytes()
    first: dict[bytes, int] = {}
    order = np.lexsort((head["start"], head["doc"]))
    lead = np.zeros(len(head), bool)
    for i, a, b in zip(order.tolist(), (ends - sizes)[order].tolist(), ends[order].tolist(), strict=True):
        lead[i] = first.setdefault(data[a:b], i) == i
    rest = head[~lead]
    count = rest["n"].astype(np.int64)
    starts = np.repeat(rest["start"] - np.cumsum(count) + count, count) + np.arange(count.sum())
    return head[lead], body[np.repeat(lead, sizes)], sizes[lead], np.repeat(rest["doc"], count), starts


def repeats(head: np.ndarray, body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the windows that also start earlier, of segments (doc, start, n) with their bytes."""
    sizes = head["n"].astype(np.int64) + length - 1
    head, body, sizes, doc0, start0 = _distinct(head, body, sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.linspace(0, len(head), min(SHARDS, len(head)) + 1).astype(int)
    parts, places = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        sa, bwt, lf = transform(body[bounds[a] : bounds[b]], sizes[a:b])
        parts.append((bwt, lf))
        starts = np.cumsum(sizes[a:b] + 1) - sizes[a:b] - 1
        string = np.searchsorted(starts, sa, "right") - 1
        places.append(np.stack([string + a, sa - starts[string]]))
    at, block = interleave(parts, length)
    string, offset = np.concatenate(places, axis=1)[:, at]
    real = offset < head["n"][string]  # windows, not the tails after them
    string, offset, block = string[real], offset[real], block[real]
    doc, start = head["doc"][string], head["start"][string] + offset
    o = np.lexsort((start, doc, block))
    later = np.zeros(len(o), bool)
    later[1:] = block[o][1:] == block[o][:-1]
    return np.concatenate([doc0, doc[o][later]]), np.concatenate([start0, start[o][later]])


def _find(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(ord, text) to packed rows (bucket, kind, blob): runs (kind 1), and covered intervals as RUNS with f the end (kind 0)."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        runs, first = reduce_runs(np.concatenate(held))
        rest, runs = runs[~first], runs[first]
        rows = []
        if len(rest):
            doc, start, end = merged(rest["doc"], rest["start"], rest["start"].astype(np.int64) + rest["n"] + (length - 1))
            out = np.zeros(len(doc), RUNS)
            out["doc"], out["start"], out["f"] = doc, start, end
            to = (mix64(doc.view(np.uint64)) % _U(buckets)).astype(np.int64)
            o = np.argsort(to, kind="stable")
            rows += [(to, 0, blob) for to, _, blob in _by_doc(0, to[o], out[o])]
        bucket = (runs["f"] % _U(buckets)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        rows += list(_by_doc(1, bucket[o], runs[o]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush(ids: list[int], parts: list[bytes], shifts: list[int]) -> None:
            nonlocal count
            sizes = np.array([len(p) for p in parts], np.int64)
            ends = np.cumsum(sizes)
            text, out = runs_of(np.frombuffer(b"".join(parts), np.uint8), ends, ends - sizes, length)
            out["doc"] = np.array(ids, np.int64)[text]
            out["start"] += (np.array(shifts, np.int64) - (ends - sizes))[text].astype(np.int32)
            held.append(out)
            count += len(out)

        for b in batches:
            ids, parts, shifts, size = [], [], [], 0
            for ord_, text in zip(b.column("ord").to_pylist(), b.column("text"), strict=True):
                data = (text.as_py() or "").encode()
                step = 8 << 20  # pieces overlap by a window less one, so each window is in one
                for a in range(0, max(1, len(data) - length + 1), step) if len(data) >= length else ():
                    ids.append(ord_)
                    parts.append(data[a : a + step + length - 1])
                    shifts.append(a)
                    size += len(parts[-1])
                    if size >= CHUNK:
                        flush(ids, parts, shifts)
                        ids, parts, shifts, size = [], [], [], 0
            if ids:
                flush(ids, parts, shifts)
            if count >= HELD:
                yield from send(held)
                held, count = [], 0
        yield from send(held)

    return map_batches(docs, run, "bucket int, kind int, blob binary")


def _reduce(packed: DataFrame, length: int) -> DataFrame:
    """Packed rows by bucket to (doc, kind, blob, size): covered intervals (0) and wanted segments (1) of a document."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_numpy(), table.column("blob").to_pylist()
        rows: list[tuple[int, int, bytes]] = []
        done = [np.frombuffer(x, RUNS) for k, x in zip(kinds, blobs, strict=True) if k == 0]
        doc, start, end = [], [], []
        for x in done:
            doc.append(x["doc"]), start.append(x["start"].astype(np.int64)), end.append(x["f"].astype(np.int64))
        runs = [np.frombuffer(x, RUNS) for k, x in zip(kinds, blobs, strict=True) if k == 1]
        if runs:
            runs, first = reduce_runs(np.concatenate(runs))
            rest, runs = runs[~first], runs[first]
            doc.append(rest["doc"]), start.append(rest["start"].astype(np.int64)), end.append(rest["start"].astype(np.int64) + rest["n"] + (length - 1))
            left = _shared(runs, np.flatnonzero(runs["lead"] > 0), "left")
            right = _shared(runs, np.flatnonzero(runs["lead"] < runs["n"]), "right")
            skip = np.where(left, 0, runs["lead"])
            want = np.empty(len(runs), WANT)
            want["f"], want["start"] = runs["f"], runs["start"] + skip
            want["n"] = np.where(right, runs["n"], runs["lead"]) - skip
            some = np.flatnonzero(left | right)
            some = some[np.argsort(runs["doc"][some], kind="stable")]
            rows += _by_doc(1, runs["doc"][some], want[some])
        if doc:
            rows += _covers(np.concatenate(doc), np.concatenate(start), np.concatenate(end))
        size = [len(r[2]) // WANT.itemsize * (length + (length - KMER) // 2) if r[1] else 0 for r in rows]
        return pa.table({"doc": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary()), "size": pa.array(size, pa.int64())})

    return packed.groupBy("bucket").applyInArrow(run, "doc long, kind int, blob binary, size long")


def _fetch(joined: DataFrame, length: int, buckets: int) -> DataFrame:
    """(ord, text, blobs of WANT) to (bucket, head, body) by minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, bodies = [], []
            for ord_, text, blobs in zip(b.column("ord").to_pylist(), b.column("text"), b.column("blobs").to_pylist(), strict=True):
                data, want = text.as_py().encode(), np.frombuffer(b"".join(blobs), WANT)
                head = np.empty(len(want), HEAD)
                head["f"], head["start"], head["n"], head["doc"] = want["f"], want["start"], want["n"], ord_
                heads.append(head)
                bodies += [data[a : a + n + length - 1] for a, n in zip(want["start"].tolist(), want["n"].tolist(), strict=True)]
            if not bodies:
                continue
            head = np.concatenate(heads)
            to = (mix64(head["f"]) % _U(buckets)).astype(np.int64)
            o = np.argsort(to, kind="stable")
            cut = np.append(np.flatnonzero(np.concatenate([[True], to[o][1:] != to[o][:-1]])), len(o))
            rows = [(int(to[o[x]]), head[o[x:y]].tobytes(), b"".join([bodies[i] for i in o[x:y].tolist()])) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "head", "body"])

    return map_batches(joined, run, "bucket int, head binary, body binary")


def _merge(segments: DataFrame, length: int) -> DataFrame:
    """(bucket, head, body) to covered intervals (doc, blob)."""

    def run(table: pa.Table) -> pa.Table:
        head = np.frombuffer(b"".join(table.column("head").to_pylist()), HEAD)
        body = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8)
        doc, start = repeats(head, body, length)
        rows = list(_covers(doc, start, start + length))
        return pa.table({"doc": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    return segments.groupBy("bucket").applyInArrow(run, "doc long, blob binary")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(ord long, unique and not null; text) to (ord, blobs): packed little-endian int32 (start, end) byte intervals to remove.

    Intervals of a row may overlap; texts without any have no row. Texts below ``length`` bytes and nulls have none.
    """
    parts = shuffle_parts(docs)
    found = saved(_reduce(_find(docs, length, 4 * parts), length))
    wanted = found.where("kind = 1").groupBy(F.col("doc").alias("ord")).agg(F.collect_list("blob").alias("blobs"))
    size = found.agg(F.sum("size")).first()[0] or 0
    few = among(docs, "ord", wanted.select("ord"))  # a bitmap, so that other texts aren't shuffled
    segments = _fetch(few.join(wanted, "ord"), length, max(parts, -(-size // MERGE_BYTES)))
    late = _merge(segments, length)
    covered = found.where("kind = 0").select("doc", "blob").union(late)
    return covered.groupBy(F.col("doc").alias("ord")).agg(F.collect_list("blob").alias("blobs"))


def ordered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with a unique long ``__ord`` in order of id (nulls last), then text.

    Whole unique ids serve as they are. Otherwise ranks are given per range of ids, on (id, hash of the text), and equal
    rows are told apart by number.
    """
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("i"))
    if ids.groupBy("i").count().where("i is null or count > 1").isEmpty():
        return df.withColumn("__ord", F.col(f"`{id_col}`").cast("long"))
    from .common import numbered

    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)
    keyed = df.withColumns({"__i": F.col(f"`{id_col}`").cast("long"), "__h": sha})
    keyed = numbered(keyed, ["__i", "__h"], "__copy")
    narrow = keyed.select("__i", "__h", "__copy").repartitionByRange(shuffle_parts(df), F.col("__i").asc_nulls_last(), "__h", "__copy")
    sort = [F.col("__i").asc_nulls_last(), F.col("__h"), F.col("__copy")]
    part = saved(narrow.withColumn("__p", F.spark_partition_id()))
    base = part.groupBy("__p").count().withColumn("__b", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = part.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*sort))).join(base, "__p").select("__i", "__h", "__copy", (F.col("__r") + F.col("__b")).cast("long").alias("__ord"))
    on = keyed["__i"].eqNullSafe(ranks["__i"]) & (keyed["__h"] == ranks["__h"]) & (keyed["__copy"] == ranks["__copy"])
    return keyed.join(ranks, on).select(*[keyed[c] for c in df.columns], ranks["__ord"])


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, characters: bool = False) -> DataFrame:
    """``df`` with columns kept (binary, the bytes left), n_bytes, n_removed and n_spans (maximal removed runs).

    Texts are UTF-8 bytes, null counts as empty; earlier means the smaller id (null last), for equal ids the smaller
    SHA-256 of the text, for equal rows any one, in the same text the earlier start. Strings are judged on the input.
    Old columns of these names are replaced, others stay. Every row gives a row. With ``characters``, what a cut leaves of
    a character goes from ``kept`` too, so that it is UTF-8; n_removed doesn't count that.
    """
    base = saved_order = ordered(df.drop("kept", "n_bytes", "n_removed", "n_spans"), id_col, text_col)
    spans = settled(lambda: repeated_spans(saved_order.select(F.col("__ord").alias("ord"), F.col(f"`{text_col}`").alias("text")), length))
    spans = spans.withColumnRenamed("ord", "__ord")
    told = marked(base, "__ord", spans.select("__ord"), "__may")  # texts without a span go by without a join
    bare = told.where("not __may").drop("__may", "__ord").withColumn("blobs", F.lit(None).cast("array<binary>"))
    joined = told.where("__may").drop("__may").join(spans, "__ord", "left").drop("__ord").union(bare)
    names = [c for c in joined.columns if c != "blobs"]
    schema = joined.drop("blobs").schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, removed, count = [], [], [], []
            for text, blobs in zip(b.column(text_col), b.column("blobs").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                sizes.append(len(data))
                if not blobs:
                    kept.append(data), removed.append(0), count.append(0)
                    continue
                pairs = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2)
                _, start, end = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                edges = [0, *np.stack([start, end], axis=1).reshape(-1).tolist(), len(data)]
                left = [data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
                kept.append(b"".join(x.decode(errors="ignore").encode() for x in left) if characters else b"".join(left))
                removed.append(int((end - start).sum())), count.append(len(start))
            more = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, count))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *more], [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return map_batches(joined.select(*names, "blobs"), run, schema)


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a 100-byte string repeated from earlier covers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[tuple[int, bytes]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """What op5 returns, by a dictionary of windows; for tests."""
    first: dict[bytes, tuple[int, int]] = {}
    out = {}
    for i, t in sorted(texts):
        for a in range(len(t) - length + 1):
            first.setdefault(t[a : a + length], (i, a))
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] != (i, a):
                gone[a : a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
