"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text, cut by quantiles of each language.

``classify`` and the query count real words by ``word_ngrams``. A document's perplexity is held against a quantile of the
perplexities of held-out trusted text in its language.

The folded model, from ``core`` to ``perplexities``, is no longer used by the query; a test holds it. There words are folded to 256 symbols: the commonest words of trusted text and word shapes (case, length, digits, punctuation, a
repeat of the word before). Trigram counts of all trusted text are summed per task, then in shards by trigram; continuation
counts and discounts follow by grouping, and the orders are joined shard by shard into log probabilities. It can't
outgrow 256^3 entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import word_ngrams
from .common import map_batches, saved, whole, words

SYMBOLS = 256
EDGE, REPEAT = 0, 1
SHAPES = ["short", "middle", "long", "capital", "upper", "upper_mark", "digits", "marks", "mixed_marks", "mixed_digits", "other", "stop"]
FIRST_WORD = 2 + len(SHAPES)
STOPS = re.compile(r"^(.*\w)[.,;:!?]$", re.S)
_UPPER_MARK = re.compile(r"^\W*[A-ZÀ-Þ]{2,}\W+$")


def core(word: str) -> str:
    """A word without one mark at its end, in lower case if only its first letter is upper."""
    m = STOPS.match(word)
    w = m.group(1) if m else word
    return w.lower() if w[:1].isupper() and not w[1:2].isupper() else w


def shape(word: str) -> int:
    w = core(word)
    if w.isalpha():
        if w.isupper() and len(w) > 1:
            name = "upper"
        else:
            name = "short" if len(w) <= 3 else "middle" if len(w) <= 7 else "long"
    elif w.isdigit():
        name = "digits"
    elif not any(map(str.isalnum, w)):
        name = "marks"
    elif _UPPER_MARK.match(w):
        name = "upper_mark"
    elif any(map(str.isdigit, w)):
        name = "mixed_digits"
    else:
        name = "mixed_marks"
    return 2 + SHAPES.index(name)


def symbols(texts: pa.Array, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts, each text closed by EDGE, and the offsets."""
    distinct, index, offsets = words(texts)
    code = np.array([vocabulary.get(core(w)) or shape(w) for w in distinct.to_pylist()], np.uint8)
    flat = code[index] if len(index) else np.zeros(0, np.uint8)
    again = np.zeros(len(index), bool)
    again[1:] = index[1:] == index[:-1]
    starts = offsets[:-1]
    again[starts[starts < len(index)]] = False
    flat = np.where(again, np.uint8(REPEAT), flat)
    out = np.insert(flat, offsets[1:], np.uint8(EDGE))
    return out, offsets + np.arange(len(offsets))


def trigrams(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Keys of 24 bits: two symbols before and the symbol; before a text stands EDGE."""
    s = flat.astype(np.int32)
    one, two = np.zeros_like(s), np.zeros_like(s)
    one[1:], two[2:] = s[:-1], s[:-2]
    one[offsets[:-1]] = EDGE
    two[offsets[:-1]] = EDGE
    second = offsets[:-1] + 1
    two[second[second < len(s)]] = EDGE
    return two << 16 | one << 8 | s


def learn_vocabulary(texts: DataFrame) -> dict[str, int]:
    """The commonest folded words of all texts, ties in order of the word, as symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            distinct, index, _ = words(whole(b.column("text")))
            for w, n in zip(distinct.to_pylist(), np.bincount(index, minlength=len(distinct)).tolist(), strict=True):
                total[core(w)] += n
            if len(total) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})

    counted = map_batches(texts.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(SYMBOLS - FIRST_WORD).collect()
    return {r["word"]: FIRST_WORD + i for i, r in enumerate(top)}


def count_trigrams(texts: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(key, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = np.zeros(0, np.int32), np.zeros(0, np.int64), []
        for b in batches:
            held.append(trigrams(*symbols(whole(b.column("text")), vocabulary)))
            if sum(map(len, held)) > 4_000_000:
                keys, counts = _summed(keys, counts, held)
                held = []
        keys, counts = _summed(keys, counts, held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(counts, pa.int64())], names=["key", "n"])

    return map_batches(texts.select("text"), run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, counts: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    more, n = np.unique(np.concatenate([np.zeros(0, np.int32), *held]), return_counts=True)
    out, inverse = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return out, np.bincount(inverse, np.concatenate([counts, n]), len(out)).astype(np.int64)


def _discounts(counts: DataFrame) -> list[float]:
    """Chen and Goodman's D1, D2, D3+ from the numbers of grams seen once to four times."""
    row = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(float(row[i]), 1.0) for i in range(4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _order(counts: DataFrame, history: str, lower: DataFrame | None, uniform: float) -> DataFrame:
    """(key, h, suffix, n) to (key, h, p, gamma): interpolated with ``lower`` (suffix, q), or with ``uniform``."""
    d1, d2, d3 = _discounts(counts)
    cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    cutting = counts.withColumn("cut", cut)
    totals = saved(cutting.groupBy("h").agg(F.sum("n").alias("all"), F.sum("cut").alias("off")).withColumn("gamma", F.col("off") / F.col("all")))
    joined = cutting.join(totals, "h")
    joined = joined.join(lower, "suffix") if lower is not None else joined.withColumn("q", F.lit(uniform))
    return joined.select("key", "h", ((F.col("n") - F.col("cut")) / F.col("all") + F.col("gamma") * F.col("q")).alias("p"), "gamma")


def fit(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trigram counts to (trigrams: key, p; bigrams: key, p, gamma of its history; histories of two: key, gamma)."""
    three = saved(counts.selectExpr("key", "shiftright(key, 8) as h", "key & 65535 as suffix", "n"))
    two = saved(three.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).selectExpr("suffix as key", "shiftright(suffix, 8) as h", "suffix & 255 as suffix", "n"))
    one = two.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).selectExpr("suffix as key", "0 as h", "0 as suffix", "n")
    p1 = saved(_order(one, "h", None, 1 / SYMBOLS))
    p2 = saved(_order(two, "h", p1.selectExpr("key as suffix", "p as q"), 0.0))
    p3 = _order(three, "h", p2.selectExpr("key as suffix", "p as q"), 0.0)
    return saved(p3), p2, p1


def log_table(p3: DataFrame, p2: DataFrame, p1: DataFrame) -> tuple[np.ndarray, ...]:
    """What tasks need: trigram keys and log probabilities, dense log gammas of two-symbol histories, dense bigram log probabilities."""
    one = np.full(SYMBOLS, 0.0)
    r1 = p1.select("key", "p", "gamma").toPandas()
    one[:] = (float(r1["gamma"].iloc[0]) if len(r1) else 1.0) / SYMBOLS
    one[r1["key"]] = r1["p"]
    r2 = p2.select("key", "h", "p", "gamma").toPandas()
    back = np.ones(SYMBOLS)
    back[r2["h"]] = r2["gamma"]
    two = (back[:, None] * one[None, :]).reshape(-1)
    two[r2["key"]] = r2["p"]
    r3 = p3.select("key", F.log("p").cast("float").alias("p")).toPandas().sort_values("key")
    gamma = np.ones(SYMBOLS * SYMBOLS)
    rh = p3.groupBy("h").agg(F.first("gamma").alias("gamma")).toPandas()
    gamma[rh["h"]] = rh["gamma"]
    return r3["key"].to_numpy(np.int32), r3["p"].to_numpy(np.float32), np.log(gamma).astype(np.float32), np.log(two).astype(np.float32)


def perplexities(df: DataFrame, vocabulary: dict[str, int], table: tuple[np.ndarray, ...], text_col: str = "text") -> DataFrame:
    """``df`` with ``perplexity`` double over the whole text and its end; null and empty texts have only the end."""
    base = df.drop("perplexity")
    names, schema = base.columns, StructType([*base.schema.fields]).add("perplexity", DoubleType())
    sent = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, p, gamma, two = sent.value
        dense = (gamma[:, None] + two.reshape(SYMBOLS, SYMBOLS)[np.arange(SYMBOLS * SYMBOLS) % SYMBOLS]).reshape(-1)
        dense[keys] = p
        for b in batches:
            flat, offsets = symbols(whole(b.column(names.index(text_col))), vocabulary)
            log = dense[trigrams(flat, offsets)].astype(np.float64)
            mean = np.add.reduceat(log, offsets[:-1]) / np.diff(offsets) if len(log) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.exp(-mean))], [*names, "perplexity"])

    return map_batches(base, run, schema)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, held_out: int = 5) -> DataFrame:
    """(doc_id, lang, text), trusted (doc_id) to (doc_id, lang, perplexity, threshold, kept).

    Counts are of all trusted texts but those whose crc32(doc_id) mod ``held_out`` is 0; those give the quantile of each
    language (null is one of its own), or of all where a language has none. Without any, every document is kept. Quantiles
    are of a mergeable sketch with 1/10,000 error in rank. Repeated ids are scored row by row.
    """
    ids = saved(trusted.select("doc_id").distinct())
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out == 0
    row = F.xxhash64("doc_id", "text").alias("row")
    learning = docs.select("doc_id", row).join(ids.where(~held), "doc_id", "left_semi").select("row")
    perplexities = word_ngrams.perplexities(docs.select(row, "text"), learning=learning)
    scored = saved(docs.select("doc_id", "lang", row).join(perplexities, "row").select("doc_id", "lang", "perplexity"))
    sample = scored.join(ids.where(held), "doc_id", "left_semi")
    at = lambda d: d.agg(F.percentile_approx("perplexity", quantile, 10000).alias("t"))
    by_lang = at(sample.groupBy(F.col("lang").alias("l")))
    overall = at(sample).first()["t"]
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    threshold = F.coalesce("t", F.lit(overall if overall is not None else float("inf")).cast("double"))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept"))


def op8_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of all documents; rows labelled quality 1 and not toxic are trusted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels.where("quality = 1 and coalesce(toxic, 0) = 0"))
