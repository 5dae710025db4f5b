"""Interpolated modified Kneser-Ney over real words: counts and scores of trigrams meet in hashed parts, packed as arrays.

Words are 64-bit hashes, and so are pairs and trigrams of them. Only trigrams of learning texts are counted. The log
probability of a trigram a b c is the sum of what its words, its pairs and itself add to it:

    log p = log gamma2(b) + log p1(c)                             words
          + log p2(c | b) - log gamma2(b) - log p1(c)             if b c was seen
          + log gamma3(a b) + log(1 + (n - D) / off3(a b) / p2)   if a b and a b c were seen

so that a text asks for its words, pairs and trigrams by themselves, wherever they are held, and sums come back by text.

Texts are cut once, into a table of buffers: the distinct words of a few thousand texts, and the numbers of the words in
these. Trigrams are worked off in slices by their middle word; a slice's shuffles and tables are gone before the next one's
are written. Within a slice Spark shuffles packed arrays to parts by the hash of a pair, whose number grows with the texts.
No part holds all of a word, and what is asked for often costs two bytes each time. A bit for each text (whether it learns) is
broadcast; nothing else is, and nothing is brought to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deleted, dropped, map_batches, mix64, noted, saved, settled, tidy, whole, words
from .minhash import word_hashes

#: Two of the first stand before a text, the second closes it: their hashes, and their numbers in every buffer.
START, END = 0, 1

#: Slices of large inputs, and bytes of text for each of a smaller one's.
SLICES, SLICE_BYTES = 24, 7_000_000

#: Words and texts of a buffer, about; texts are numbered in 16 bits there.
BUFFER_WORDS, BUFFER_TEXTS = 5_000_000, 30_000

#: Bytes of messages that a part of a slice may take, about; texts make six times their own in all slices.
PART_BYTES, MESSAGE_SHARE = 48_000_000, 6

#: What goes to a part, or comes back from it: counts of trigrams, questions, sums of texts, and the buffer's row numbers.
COUNTS, ASKED, SUMS, ROWS = range(4)
MESSAGE = "part int, kind int, buffer long, keys binary, more binary, at binary"

_HIGH = np.uint64(32)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a) ^ b)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _order(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    by_key = np.argsort(key)
    return by_key[np.argsort(group[by_key], kind="stable")]


def _cuts(keys: np.ndarray, spread: int) -> np.ndarray:
    """Where ordered keys are cut into parts."""
    return np.searchsorted((keys >> _HIGH) * np.uint64(spread) >> _HIGH, np.arange(spread + 1, dtype=np.uint64))


def _found(keys: np.ndarray, known: np.ndarray, values: np.ndarray, none: float = 0.0) -> np.ndarray:
    """The values of ``keys`` among ordered ``known``, and ``none`` of those that aren't there."""
    if not len(known):
        return np.full(len(keys), none)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], none)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "kind": pa.int32(), "buffer": pa.int64(), "keys": pa.binary(), "more": pa.binary(), "at": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _arrays(cells: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in cells]


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


# Buffers of texts


def buffers(docs: DataFrame) -> DataFrame:
    """(row long, text) to rows of (buffer, words, tokens, sizes, rows).

    Words are numbered by how often they occur; numbers are cut into planes of bytes and compressed, which makes them
    smaller than the compressed text. ``sizes`` are words of each text and three more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept, n_words, n_texts = TaskContext.get().partitionId() << 32, [], 0, 0
        for large in batches:
            for at in range(0, large.num_rows, 10_000):
                batch = large.slice(at, 10_000)
                distinct, index, offsets = words(whole(batch.column("text")))
                kept.append((word_hashes(distinct), index, np.diff(offsets), batch.column("row").to_numpy(zero_copy_only=False)))
                n_words, n_texts = n_words + len(index), n_texts + batch.num_rows
                if n_words >= BUFFER_WORDS or n_texts >= BUFFER_TEXTS:
                    yield _buffer(number, kept)
                    number, kept, n_words, n_texts = number + 1, [], 0, 0
        if kept:
            yield _buffer(number, kept)

    return map_batches(docs.select("row", "text"), run, "buffer long, words binary, tokens binary, sizes binary, rows binary")


def _buffer(number: int, kept: list[tuple]) -> pa.RecordBatch:
    known = np.sort(np.concatenate([x[0] for x in kept]))
    known = known[_starts(known)]
    index = np.concatenate([np.searchsorted(known, h)[i] for h, i, *_ in kept])
    by_use = np.argsort(-np.bincount(index, minlength=len(known)))
    rank = np.empty(len(known), np.uint32)
    rank[by_use] = np.arange(2, len(known) + 2, dtype=np.uint32)
    sizes = np.concatenate([x[2] for x in kept]) + 3
    ends = np.cumsum(sizes) - 1
    tokens, inner = np.full(int(sizes.sum()), START, np.uint32), np.ones(int(sizes.sum()), bool)
    tokens[ends] = END
    inner[ends] = inner[ends - sizes + 1] = inner[ends - sizes + 2] = False
    tokens[inner] = rank[index]
    hashes = np.concatenate([np.array([START, END], np.uint64), known[by_use]])
    cells = {"buffer": number, "words": hashes.tobytes(), "tokens": _packed(tokens), "sizes": sizes.astype(np.int32).tobytes(), "rows": np.concatenate([x[3] for x in kept]).tobytes()}
    return pa.RecordBatch.from_pydict({k: [v] for k, v in cells.items()})


def _packed(tokens: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4)[:, :3].T)
    return len(tokens).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(cell: bytes) -> np.ndarray:
    n = int.from_bytes(cell[:8], "little")
    out = np.zeros((n, 4), np.uint8)
    if n:
        out[:, :3] = np.frombuffer(pa.decompress(cell[8:], 3 * n, "zstd"), np.uint8).reshape(3, n).T
    return out.reshape(-1).view(np.uint32)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(buffer, words, tokens, sizes, which texts learn) of each row; without a column ``learn`` all do."""
    for x in batch.to_pylist():
        sizes = np.frombuffer(x["sizes"], np.int32)
        learn = np.unpackbits(np.frombuffer((x["learn"] or b"").ljust(1 << 13, b"\0"), np.uint8))[: len(sizes)].astype(bool) if "learn" in x else None
        yield x["buffer"], np.frombuffer(x["words"], np.uint64), _unpacked(x["tokens"]), sizes, learn


def _with_flags(table: DataFrame, learning: DataFrame) -> DataFrame:
    """Buffers with ``learn``: a bit for each text, whether its row is in ``learning`` (row). The bits are broadcast, the buffers stay where they are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                row = np.frombuffer(x["rows"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), x["buffer"])), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=["buffer", "at", "row"])

    def bits(texts: pa.Table) -> pa.Table:
        learn = np.zeros(1 << 16, bool)
        learn[texts["at"].to_numpy()] = True
        return pa.table({"buffer": texts["buffer"][:1], "learn": pa.array([np.packbits(learn).tobytes().rstrip(b"\0")], pa.binary())})

    found = map_batches(table.select("buffer", "rows"), places, "buffer long, at int, row long").join(learning, "row", "left_semi")
    return table.join(F.broadcast(saved(found.groupBy("buffer").applyInArrow(bits, "buffer long, learn binary"))), "buffer", "left")


def _learned(table: DataFrame) -> DataFrame:
    """Buffers of learning texts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buffer, hashes, tokens, sizes, learn in _read(batch):
                tokens = tokens[np.repeat(learn, sizes)]
                used = np.zeros(len(hashes), bool)
                used[[START, END]] = used[tokens] = True
                tokens = (np.cumsum(used) - 1).astype(np.uint32)[tokens]
                if len(tokens):
                    yield pa.RecordBatch.from_pydict({"buffer": [buffer], "words": [hashes[used].tobytes()], "tokens": [_packed(tokens)], "sizes": [sizes[learn].tobytes()]})

    return map_batches(table.select("buffer", "words", "tokens", "sizes", "learn"), run, "buffer long, words binary, tokens binary, sizes binary")


def _in_slice(hashes: np.ndarray, part: int, parts: int) -> np.ndarray:
    return mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts) == part


def _asking(buffer: int, keys: np.ndarray, texts: np.ndarray, spread: int, above: np.ndarray | None = None) -> list[tuple]:
    """Questions for ordered ``keys`` by the texts that hold them, to the parts of ``above`` where that is given."""
    first = _starts(keys)
    all_starts, keys = np.append(first, len(keys)), keys[first]
    times = np.diff(all_starts).astype(np.uint32)
    cuts = _cuts(keys if above is None else above[first], spread)
    rows = []
    for part, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if i < j:
            more = times[i:j].tobytes() if above is None else above[first[i:j]].tobytes() + times[i:j].tobytes()
            rows.append((part, ASKED, buffer, keys[i:j].tobytes(), more, texts[all_starts[i] : all_starts[j]].tobytes()))
    return rows


def _answers(row: dict, weights: np.ndarray, times: np.ndarray) -> tuple:
    """What a question's keys add to its texts."""
    texts = np.frombuffer(row["at"], np.uint16)
    sums = np.bincount(texts, np.repeat(weights, times))
    some = np.flatnonzero(sums)
    return (None, SUMS, row["buffer"], sums[some].tobytes(), b"", some.astype(np.uint16).tobytes())


def _grams(table: DataFrame, part: int, parts: int, spread: int, counts: bool, ask: str | None) -> DataFrame:
    """Messages of a slice: the trigrams of learning texts with their counts to the part of b c, and questions for pairs (part of b c) or trigrams (part of a b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buffer, hashes, tokens, sizes, learn in _read(batch):
                at = np.flatnonzero(_in_slice(hashes, part, parts)[tokens[1:-1]])
                at = at[tokens[at + 2] != START]
                text = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[at]
                a, b, c = (hashes[tokens[at + i]] for i in range(3))
                rows = []
                if ask == "pairs":
                    bc = pair_key(b, c)
                    order = np.argsort(bc)
                    rows += _asking(buffer, bc[order], text[order], spread)
                if ask == "trigrams":
                    ab = pair_key(a, b)
                    abc = mix64(ab ^ c)
                    order = _order(ab, abc)
                    rows += _asking(buffer, abc[order], text[order], spread, ab[order])
                if counts:
                    if learn is not None:
                        a, b, c = (x[learn[text]] for x in (a, b, c))
                    ab, bc = pair_key(a, b), pair_key(b, c)
                    abc = mix64(ab ^ c)
                    order = _order(bc, abc)
                    first = _starts(abc[order])
                    n = np.diff(np.append(first, len(order))).astype(np.uint32)
                    ab, abc, b, c, bc = (x[order[first]] for x in (ab, abc, b, c, bc))
                    cuts = _cuts(bc, spread)
                    for to, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                        if i < j:
                            rows.append((to, COUNTS, buffer, abc[i:j].tobytes(), b"".join(x[i:j].tobytes() for x in (ab, b, c)), n[i:j].tobytes()))
                yield _messages(rows)

    return map_batches(table.drop("rows"), run, MESSAGE)


def _counted(messages: pa.Table) -> tuple[np.ndarray, ...]:
    """(abc, ab, b, c, n) of a part's trigrams in order of b c, and where its pairs begin."""
    mine = messages.filter(pa.compute.equal(messages["kind"], COUNTS))
    more = [x.reshape(3, -1) for x in _arrays(mine["more"], np.uint64)]
    abc, n = _joined(_arrays(mine["keys"], np.uint64), np.uint64), _joined(_arrays(mine["at"], np.uint32), np.int64)
    ab, b, c = (_joined([x[i] for x in more], np.uint64) for i in range(3))
    bc = pair_key(b, c)
    order = _order(bc, abc)
    first = _starts(abc[order])
    n = np.add.reduceat(n[order], first) if len(first) else n
    at = order[first]
    return abc[at], ab[at], b[at], c[at], n, _starts(bc[at])


# The model


def _discounts(tally: np.ndarray) -> np.ndarray:
    """0 and Chen and Goodman's D1, D2, D3+, from how many grams were seen once to four times."""
    n1, n2, n3, n4 = np.maximum(tally, 1.0).tolist()
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


def _tally(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == i)) for i in (1, 2, 3, 4)]


STATISTICS = "part int, word long, total long, one long, two long, more long, before long"


def _statistics(messages: pa.Table) -> pa.Table:
    """Of each word of a part: seen pairs that it begins (trigrams of them, pairs seen after one, two, more words) and how many words stand before it.

    Two rows without a word have the tallies of trigrams (part -1) and of pairs (part -2).
    """
    _, _, b, c, n, pairs = _counted(messages)
    seen = np.diff(np.append(pairs, len(n)))
    b, c = b[pairs], c[pairs]
    known = np.sort(np.concatenate([b, c]))
    known = known[_starts(known)]
    begins = np.searchsorted(known, b)
    sums = [np.bincount(begins, x, len(known)).astype(np.int64) for x in (seen, seen == 1, seen == 2, seen > 2)]
    before = np.bincount(np.searchsorted(known, c), minlength=len(known))
    part = messages["part"][0].as_py()
    columns = [np.full(len(known), part), known.view(np.int64), *sums, before]
    out = pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), *[pa.int64()] * 6], strict=True)], names=["part", "word", "total", "one", "two", "more", "before"])
    tallies = [dict(zip(out.column_names, [k, None, *t, 0], strict=True)) for k, t in ((-1, _tally(n)), (-2, _tally(seen)))]
    return pa.concat_tables([out, pa.Table.from_pylist(tallies, out.schema)])


def _cut(d: np.ndarray, seen: Column) -> Column:
    return F.when(seen == 1, float(d[1])).when(seen == 2, float(d[2])).otherwise(float(d[3]))


def _word_model(statistics: list[DataFrame]) -> tuple[DataFrame, float, float, np.ndarray, np.ndarray]:
    """(word, p1, total, gamma) of seen words, p1 of any other and of those after one word alone, and what is cut off the counts of pairs and of trigrams.

    ``total`` and ``gamma`` are null of what begins no pair, ``p1`` of START.
    """
    every = reduce(DataFrame.union, statistics)
    tallies = {r["part"]: np.array(r[1:], float) for r in every.where("word is null").groupBy("part").agg(*[F.sum(x) for x in ("total", "one", "two", "more")]).collect()}
    triples, pairs = (_discounts(tallies.get(k, np.zeros(4))) for k in (-1, -2))
    fewer = (len(statistics) + 3) // 4
    some = []
    for part in range(fewer):  # one after another, for the sake of their shuffles
        mine = every.where(F.pmod("word", F.lit(fewer)) == part)  # a null word is in none
        some.append(saved(mine.groupBy("word").agg(*[F.sum(x).alias(x) for x in ("total", "one", "two", "more", "before")])))
    sums = reduce(DataFrame.union, some)
    met = sums.where("before > 0")
    row = met.agg(*[F.count(F.when(F.col("before") == i, 1)) for i in (1, 2, 3, 4)], F.sum("before").alias("all"), F.count(F.lit(1)).alias("types")).first()
    d = _discounts(np.array(row[:4], float))
    cut = _cut(d, F.col("before"))
    uniform = 1.0 / (row["types"] + 1)  # all seen words and one for any other
    other = met.agg(F.sum(cut)).first()[0] / row["all"] * uniform if row["all"] else uniform
    p1 = F.when(F.col("before") > 0, (F.col("before") - cut) / F.lit(float(row["all"] or 1)) + F.lit(other))
    off = F.col("one") * float(pairs[1]) + F.col("two") * float(pairs[2]) + F.col("more") * float(pairs[3])
    begins = F.col("total") > 0
    ones = saved(sums.select("word", p1.alias("p1"), F.when(begins, F.col("total")).cast("double").alias("total"), F.when(begins, off / F.col("total")).alias("gamma")))
    dropped(*some)
    return ones, other, (1 - float(d[1])) / (row["all"] or 1) + other, pairs, triples


def _answered_pairs(rare: float, d2: np.ndarray, spread: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part's trigrams with p2 of their pairs, sent on to the parts of a b, and what seen pairs add to texts.

    Words that the model lacks follow one word and stand before one: their p1 is ``rare``.
    """

    def run(messages: pa.Table, model: pa.Table) -> pa.Table:
        abc, ab, b, c, n, pairs = _counted(messages)
        seen = np.diff(np.append(pairs, len(n)))
        b, c = b[pairs], c[pairs]
        known = model["word"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        total, gamma, p1 = (np.nan_to_num(model[x].to_numpy())[order] for x in ("total", "gamma", "p1"))
        known = known[order]
        lower = _found(b, known, gamma, d2[1]) * _found(c, known, p1, rare)
        p2 = (seen - d2[np.minimum(seen, 3)]) / _found(b, known, total, 1.0) + lower
        keys, added = pair_key(b, c), np.log(p2) - np.log(lower)
        rows = []
        order = _order(ab, abc)
        abc, ab, n, p = abc[order], ab[order], n[order].astype(np.int64), np.repeat(p2, seen)[order]
        cuts = _cuts(ab, spread)
        for to, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if i < j:
                rows.append((to, COUNTS, None, abc[i:j].tobytes(), ab[i:j].tobytes() + p[i:j].tobytes(), n[i:j].tobytes()))
        for x in messages.filter(pa.compute.equal(messages["kind"], ASKED)).to_pylist():
            rows.append(_answers(x, _found(np.frombuffer(x["keys"], np.uint64), keys, added), np.frombuffer(x["more"], np.uint32)))
        return pa.Table.from_batches([_messages(rows)])

    return run


def _answered_trigrams(d3: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """What seen histories and trigrams add to texts."""

    def run(messages: pa.Table) -> pa.Table:
        mine = messages.filter(pa.compute.equal(messages["kind"], COUNTS))
        abc, n = _joined(_arrays(mine["keys"], np.uint64), np.uint64), _joined(_arrays(mine["at"], np.int64), np.int64)
        more = [x.reshape(2, -1) for x in _arrays(mine["more"], np.uint64)]
        ab, p2 = _joined([x[0] for x in more], np.uint64), _joined([x[1].view(np.float64) for x in more], np.float64)
        order = np.argsort(ab)
        abc, ab, n, p2 = abc[order], ab[order], n[order], p2[order]
        first = _starts(ab)
        cut = d3[np.minimum(n, 3)]
        off, total = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (cut, n))
        histories, gamma = ab[first], np.log(off / total)
        added = np.log1p((n - cut) / np.repeat(off, np.diff(np.append(first, len(ab)))) / p2)
        order = np.argsort(abc)
        abc, added = abc[order], added[order]
        rows = []
        for x in messages.filter(pa.compute.equal(messages["kind"], ASKED)).to_pylist():
            keys = np.frombuffer(x["keys"], np.uint64)
            above, times = np.frombuffer(x["more"], np.uint64, len(keys)), np.frombuffer(x["more"], np.uint32, offset=8 * len(keys))
            rows.append(_answers(x, _found(keys, abc, added) + _found(above, histories, gamma), times))
        return pa.Table.from_batches([_messages(rows)])

    return run


def _summed(messages: pa.Table) -> pa.Table:
    """One row of sums for a buffer."""
    sums = np.zeros(1 << 16)
    for at, x in zip(_arrays(messages["at"], np.uint16), _arrays(messages["keys"], np.float64), strict=True):
        sums[at] += x
    some = np.flatnonzero(sums)
    return pa.Table.from_batches([_messages([(None, SUMS, messages["buffer"][0].as_py(), sums[some].tobytes(), b"", some.astype(np.uint16).tobytes())])])


def _slice(table: DataFrame, part: int, parts: int, spread: int, model: DataFrame, rare: float, d2: np.ndarray, d3: np.ndarray) -> DataFrame:
    """What a slice's pairs and trigrams add to the texts: one row of SUMS for each buffer."""
    asked = _grams(table, part, parts, spread, True, "pairs").groupBy("part")
    first = saved(asked.cogroup(model.groupBy("part")).applyInArrow(_answered_pairs(rare, d2, spread), MESSAGE))
    del asked, model
    tidy(table.sparkSession)  # the shuffles behind ``first``, which nothing names any more
    second = first.where(F.col("kind") == COUNTS).union(_grams(table, part, parts, spread, False, "trigrams"))
    second = second.groupBy("part").applyInArrow(_answered_trigrams(d3), MESSAGE)
    return first.where(F.col("kind") == SUMS).union(second).groupBy("buffer").applyInArrow(_summed, MESSAGE)


def _of_words(table: DataFrame, part: int, parts: int, spread: int, ones: DataFrame, other: float) -> DataFrame:
    """What a slice's words add to the texts beside ``other`` for each: one row of SUMS for each buffer."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buffer, hashes, tokens, sizes, _ in _read(batch):
                once = tokens != START
                once[np.cumsum(sizes) - sizes] = True  # one START begins a pair
                at = np.flatnonzero(_in_slice(hashes, part, parts)[tokens] & once)
                text = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[at]
                keys = hashes[tokens[at]]
                order = np.argsort(keys, kind="stable")
                yield _messages(_asking(buffer, keys[order], text[order], spread))

    def answer(messages: pa.Table, model: pa.Table) -> pa.Table:
        known, added = model["word"].to_numpy().view(np.uint64), model["added"].to_numpy()
        order = np.argsort(known)
        known, added = known[order], added[order]
        rows = [_answers(x, _found(np.frombuffer(x["keys"], np.uint64), known, added), np.frombuffer(x["more"], np.uint32)) for x in messages.to_pylist()]
        return pa.Table.from_batches([_messages(rows)])

    asked = map_batches(table.select("buffer", "words", "tokens", "sizes"), ask, MESSAGE)
    to = F.shiftright(F.shiftrightunsigned("word", 32) * spread, 32).cast("int").alias("part")
    model = ones.select(to, "word", (F.coalesce(F.log("gamma"), F.lit(0.0)) + F.coalesce(F.log(F.col("p1") / F.lit(other)), F.lit(0.0))).alias("added"))
    return asked.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(answer, MESSAGE).groupBy("buffer").applyInArrow(_summed, MESSAGE)


def _scored(other: float) -> Callable[[pa.Table], pa.Table]:
    """A buffer's sums and rows to (row, perplexity)."""

    def run(messages: pa.Table) -> pa.Table:
        own = messages.filter(pa.compute.equal(messages["kind"], ROWS))
        row, n = (_arrays(own[x], t)[0] for x, t in (("keys", np.int64), ("at", np.int32)))
        log = (n - 2) * np.log(other)
        sums = messages.filter(pa.compute.equal(messages["kind"], SUMS))
        for at, x in zip(_arrays(sums["at"], np.uint16), _arrays(sums["keys"], np.float64), strict=True):
            log[at] += x
        return pa.Table.from_arrays([pa.array(row), pa.array(np.exp(-log / (n - 2)))], names=["row", "perplexity"])

    return run


def perplexities(docs: DataFrame, parts: int | None = None, learning: DataFrame | None = None) -> DataFrame:
    """(row, text) to (row, perplexity): over the whole text and its end; null and empty texts have only the end.

    Rows of one number are one text; counts are of texts whose number is in ``learning`` (row), or that have a true ``learn``
    if it isn't given. Texts are never shuffled. ``parts`` slices, by the size of the texts if not given.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if parts is None:
        parts = int(min(SLICES, 1 + size // SLICE_BYTES))
    spread = int(2 + MESSAGE_SHARE * size // parts // PART_BYTES)
    learning = docs.where("learn").select("row") if learning is None else learning
    with noted() as made:
        table = saved(buffers(docs))
        flagged = _with_flags(table, learning)
        learned = saved(_learned(flagged))
    statistics = []
    for part in range(parts):
        statistics.append(saved(_grams(learned, part, parts, spread, True, None).groupBy("part").applyInArrow(_statistics, STATISTICS)))
    dropped(learned)
    ones, other, rare, d2, d3 = _word_model(statistics)
    others = ones.where(~(F.col("p1").eqNullSafe(F.lit(rare)) & F.col("total").eqNullSafe(F.lit(1.0))))
    fewer = (parts + 3) // 4  # words alone, which take less room
    sums = [settled(lambda part=part: _of_words(table, part, fewer, spread, ones, other)) for part in range(fewer)]
    rows = table.select(F.lit(None).cast("int").alias("part"), F.lit(ROWS).alias("kind"), "buffer", F.col("rows").alias("keys"), F.lit(b"").alias("more"), F.col("sizes").alias("at"))
    out = saved(reduce(DataFrame.union, [rows, *sums]))
    dropped(*sums)
    for part in range(parts):
        model = lambda part=part: statistics[part].where("word is not null").select("part", "word").join(others.hint("shuffle_hash"), "word")
        out = out.union(settled(lambda part=part, model=model: _slice(flagged, part, parts, spread, model(), rare, d2, d3)))
        dropped(statistics[part])
        tidy(docs.sparkSession)
    dropped(ones)
    deleted(docs.sparkSession, made)
    tidy(docs.sparkSession)
    return out.groupBy("buffer").applyInArrow(_scored(other), "row long, perplexity double").groupBy("row").agg(F.max("perplexity").alias("perplexity"))
