"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set holds the hashes of its distinct word shingles. The set's permuted hashes fall into BINS equal ranges and
the least of each range is its sketch; an empty range borrows from the first non-empty range of a probe sequence that
depends only on (range, attempt), so borrowed values collide with the sets' similarity. Four ranges make a band, equal
bands share a bucket. Sets whose own shingles, which no other set has, rule every link out go first. The candidates of
what is left are stars: the members of a bucket with its hubs, those in the middle of a cluster. Hubs leave and further
ones follow until each bucket is used up or of one component; nothing is capped. Links are confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, components, dropped, map_batches, mix64, ragged, saved, whole, words

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_MASK = (1 << 64) - 1


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; of fewer words, the one of all; of none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, 0x9E3779B97F4A7C15 * width & _MASK, np.uint64)
    for i in range(width):
        out = mix64(out ^ hashes[i : n - width + 1 + i])
    return out


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(hashes, k))


def _probes() -> np.ndarray:
    """For each bin, the bins to borrow from, in order: hashed attempts, then all others."""
    tries = np.arange(6 * BINS, dtype=np.uint64)
    hashed = (mix64(np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32) | tries) % np.uint64(BINS)).astype(np.int64)
    rest = (np.arange(BINS)[:, None] + np.arange(1, BINS)) % BINS
    return np.concatenate([hashed, rest], axis=1)


PROBES = _probes()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a non-empty sorted set."""
    at = np.searchsorted(shingles, EDGES)
    after = np.append(at[1:], len(shingles))
    full = at < after
    out = shingles[np.minimum(at, len(shingles) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        source = PROBES[empty]
        out[empty] = out[source[np.arange(len(empty)), full[source].argmax(axis=1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(n, BINS) sketches to (n, BANDS) bucket keys; the band is part of the key."""
    grouped = sketches.reshape(len(sketches), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(sketches), 1), np.uint64)
    for i in range(ROWS):
        key = mix64(key ^ grouped[:, :, i])
    return key.view(np.int64)


def _each(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    distinct, index, offsets = words(whole(b.column("text")))
    hashes = word_hashes(pa.compute.ascii_lower(distinct))[index]
    for i, s, e in ragged(offsets):
        yield i, shingle_set(hashes[s:e], k)


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's members in a power of two of hash classes, about 16 for 9 members, as longs.

    Classes in which two sets' parities differ are no more than the members that only one of both has.
    """
    n = 64 << max(0, (16 * len(s) // 9 // 64).bit_length())
    odd = np.bincount((s >> np.uint64(7) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SIGNED = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, row, text) to (id, row, n_shingles, digest of the set, bands); an empty set has no digest and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, rows, sketches = [], [], [], []
            for i, s in _each(b, k):
                counts.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                if len(s):
                    rows.append(i)
                    sketches.append(sketch(s))
            bands: list = [None] * len(counts)
            for i, keys in zip(rows, band_keys(np.array(sketches)) if rows else [], strict=True):
                bands[i] = keys
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=SIGNED)

    return map_batches(docs, run, "id long, row long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(text) to (digest, shingles, odd sketch), a row for each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, s in _each(b, k) if len(s)]
            lists = (pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], [odd_sketch(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), *lists], names=["digest", "shingles", "odd"])

    return map_batches(docs.select("text"), run, "digest binary, shingles array<long>, odd array<long>")


def _crowded(members: DataFrame) -> DataFrame:
    """Members of buckets that hold two labels or more."""
    keys = saved(members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"))
    out = saved(members.join(keys.hint("merge"), "key"))
    dropped(keys)
    return out


def _able(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members`` (key, node, at) with ``size``, ``shared``, ``rank`` and ``label``, without those that can't link with any other.

    A set's shingles that no other set here has are in no intersection: with ``shared`` others, similarity is at most
    shared / size. Ranks grow with the sizes of a node's buckets: what lies in the middle of a cluster comes first.
    """
    single = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    own = single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("node", F.size("shingles").cast("long").alias("size")).join(own, "node", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0)))
    crowd = members.join(saved(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))).hint("merge"), "key").groupBy("node").agg(F.sum("n").alias("rank"))
    facts = saved(sizes.where(f"100 * shared >= {percent} * size").join(crowd, "node").select("node", "size", "shared", "rank"))
    return members.join(facts.hint("merge"), "node").withColumn("label", F.col("node"))


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with labels joined by ``links`` (x, y) between labels."""
    joined = saved(components(links.selectExpr("x as a", "y as b")).withColumnsRenamed({"id": "label", "component": "root"}))
    return members.join(joined, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b, x, y) those that link, by their whole sets."""
    s, t = (sets.select(F.col("node").alias(n), F.col("shingles").alias(v)).hint("merge") for n, v in (("a", "s"), ("b", "t")))
    sized = pairs.join(t, "b").join(s, "a").withColumn("both", F.size(F.array_intersect("s", "t")).cast("long"))
    return saved(sized.where(f"100 * both >= {percent} * (size(s) + size(t) - both)").select("a", "b", "x", "y"))


def _allowed(percent: int, sketches: bool) -> Column:
    """Whether members l and r, of unlike labels, may link for their sizes, shared shingles and, with ``sketches``, odd sketches.

    With S the sum of sizes and m the shingles that only one has, similarity is (S - m) / (S + m). Sketches of unlike
    lengths, which similar sets have at a class's border, rule nothing out.
    """
    both, sum_ = F.least("l.shared", "r.shared"), F.col("l.size") + F.col("r.size")
    out = (F.col("l.label") != F.col("r.label")) & (100 * both >= percent * (sum_ - both))
    if not sketches:
        return out
    unlike = F.aggregate(F.zip_with("l.odd", "r.odd", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    return out & ((F.size("l.odd") != F.size("r.odd")) | (100 * (sum_ - unlike) >= percent * (sum_ + unlike)))


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that give the components of all links between members (key, node, at) of a bucket.

    Each bucket has hubs, its members of highest rank. First each node meets the highest of its buckets' hubs: one pair
    a node. Later all members meet the hubs of their buckets, 1, 256, 65,536, ... in turn; then these hubs leave all
    buckets. So does each bucket whose members are known to be of one component. Nothing else leaves, so no link between
    components is lost. A pair meets in the first bucket that both are in, and only if a link is possible by ``_allowed``.
    """
    able = _able(members, sets, percent)
    same = F.col("l.key") == F.col("r.key")
    first_met = ~F.arrays_overlap(F.slice("l.bands", F.lit(1), F.col("l.at")), F.slice("r.bands", F.lit(1), F.col("r.at")))
    ends = (F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.label").alias("x"), F.col("r.label").alias("y"))
    pool, found, slots = _crowded(able), [], 0
    while not pool.isEmpty():
        if slots == 0:
            hub = F.max(F.struct("rank", "node", "label", "size", "shared")).alias("hub")
            hubs = saved(pool.groupBy("key").agg(hub).select("key", "hub.*"))
            met = pool.alias("l").join(hubs.alias("r").hint("merge"), same & _allowed(percent, False))
            best = met.groupBy(F.col("l.node").alias("a"), F.col("l.label").alias("x")).agg(F.max(F.struct("r.rank", "r.node", "r.label")).alias("of"))
            pairs, stays = saved(best.select("a", F.col("of.node").alias("b"), "x", F.col("of.label").alias("y"))), pool
        else:
            slot = F.pmod(F.xxhash64(F.lit(slots), "node"), F.lit(slots)).alias("slot")
            hubs = saved(pool.groupBy("key", slot).agg(F.max(F.struct("rank", "node")).alias("hub")).select("hub.node").distinct())
            stars = saved(pool.join(hubs.hint("merge"), "node"))
            met = pool.alias("l").join(stars.alias("r").hint("merge"), same & _allowed(percent, True) & first_met).select(*ends)
            once = met.join(hubs.select(F.col("node").alias("a"), F.lit(True).alias("hub")).hint("merge"), "a", "left").where("hub is null or a < b").drop("hub")
            pairs, stays = saved(once), pool.join(hubs.hint("merge"), "node", "left_anti")
            dropped(stars)
        links = _linked(pairs, sets, percent)
        found.append(links)
        new = _crowded(stays if links.isEmpty() else _relabelled(stays, links.select("x", "y").distinct()))
        dropped(pool, hubs, pairs)
        if slots == 0:
            dealt, new = new, saved(new.join(sets.select("node", "bands", "odd").hint("merge"), "node"))
            dropped(dealt)
        pool, slots = new, max(1, slots * 256)
    return reduce(DataFrame.union, (f.select("a", "b") for f in found)) if found else sets.sparkSession.createDataFrame([], "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, percent: int = 80, key_col: str | None = None) -> DataFrame:
    """A row for each row of ``df``: id, n_shingles, component_id (least id reachable by links), kept.

    Words are runs of non-white-space after A-Z are lower-cased. Rows link when 100 * intersection >= percent * union of
    their shingle sets; equal sets always do, whatever their ids. Null and empty texts have no set, link with nothing and
    are their own component. A row with a null id gets the least id of its component, or null, and isn't kept unless it
    has no set. Sketches find a pair at similarity 0.8 with probability above 1 - 1e-7. An empty table gives an empty
    result; extra columns are left out.

    With ``key_col``, a long that is never null and stands for id and text, the result has it too, and kept are of each
    component the rows of one key alone: that of the least (id, key), a null id last.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("row", F.xxhash64("id", "text"))
    if key_col is not None:
        docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{key_col}`").alias("row"))
    signed = saved(signatures(docs, words_per_shingle).withColumn("at", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = saved(signed.where("digest is not null").groupBy("digest").agg(F.min("at").alias("node"), least.alias("of"), F.first("bands").alias("bands")))
    buckets = classes.select("node", F.posexplode("bands").alias("at", "key"))
    full = saved(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    members = saved(buckets.select("key", "node", "at").join(full.hint("merge"), "key"))
    pool = saved(members.select("node").distinct())
    wanted = saved(classes.join(pool.hint("merge"), "node").select("digest", "node", "bands", "of.row"))
    texts = among(docs, "row", wanted.select("row"))
    found = shingle_sets(texts, words_per_shingle).groupBy("digest").agg(F.first("shingles").alias("shingles"), F.first("odd").alias("odd"))
    sets = saved(found.join(wanted.select("digest", "node", "bands"), "digest").drop("digest"))
    joined = components(_links(members, sets, percent))
    tops = classes.select("digest", "node", "of").join(joined.withColumnRenamed("id", "node"), "node", "left").select("digest", "of", F.coalesce("component", "node").alias("component"))
    if key_col is not None:
        best = saved(tops.groupBy("component").agg(F.min("of").alias("best")).select("component", F.col("best.id").alias("component_id"), F.col("best.row").alias("best")))
        owner = saved(tops.join(best, "component").select("digest", "component_id", "best"))
        out = signed.select("id", "row", "n_shingles", "digest").join(owner, "digest", "left")
        own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
        kept = F.col("digest").isNull() | (F.col("row") == F.col("best"))
        return out.select(F.col("id").alias(id_col), F.col("row").alias(key_col), "n_shingles", own.alias("component_id"), kept.alias("kept"))
    best = saved(tops.groupBy("component").agg(F.min("of.id").alias("component_id")))
    owner = saved(tops.join(best, "component").select("digest", "component_id"))
    out = signed.select("id", "n_shingles", "digest").join(owner, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.when(F.col("digest").isNull(), True).otherwise(F.coalesce(F.col("id") == own, F.lit(False)))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), kept.alias("kept"))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words_per_shingle=4)
