"""Merges learned from words, leaking windows, byte codes, recovery of vectors, and a ledger that survives a crash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.operators import bpe, gram, leakage
from tessera.operators import ledger as ledgers
from tessera.shipping import ship
from tessera.sources.files import scratch

from .dialect import Duck, Spark
from .ledgers import _steps
from .shards import _docs

#: How often a language's texts count, as if they were repeated; others count once.
REPEATED = {"de": 2, "es": 2}
MERGES = 24


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _words(docs: DataFrame) -> DataFrame:
    times = F.lit(1)
    for lang, k in REPEATED.items():
        times = F.when(F.col("lang") == lang, k).otherwise(times)
    each = docs.select(times.alias("n"), F.explode(F.expr(Spark().words("text"))).alias("word"))
    return each.groupBy("word").agg(F.sum("n").cast("long").alias("n"))


def _merges(spark: SparkSession, sf_dir: str, kind: str, least: int) -> DataFrame:
    found = bpe.learn_merges(_words(_documents(spark, sf_dir)), MERGES, kind, least)
    return spark.createDataFrame([(i, a, b, n) for i, (a, b, n) in enumerate(found)], "rank int, left string, right string, n long")


def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first merges of a tokenizer over code points, learned from all words, two languages counting twice."""
    return _merges(spark, sf_dir, "chars", 1)


def byte_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first merges over bytes (written as the code points 0 to 255), of pairs that occur twice at least."""
    return _merges(spark, sf_dir, "bytes", 2)


WINDOW, WINDOWS = 64, 200


def window_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 windows of 64 words drawn from the evaluation split by hash, and in how many places and training documents each stands."""
    docs = spark.sql(f"select doc_id, split, {Spark().words('text')} as words from ({_docs(Spark())}) d".replace("{documents}", "{docs}"), docs=_documents(spark, sf_dir))
    starts = F.expr(f"case when size(words) >= {WINDOW} then sequence(0L, cast(size(words) - {WINDOW} as bigint), 16L) else cast(array() as array<bigint>) end")
    every = docs.where("split = 'eval'").select("doc_id", "words", F.explode(starts).alias("start"))
    draw = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string")), 256)
    drawn = every.select("doc_id", "start", F.slice("words", F.col("start").cast("int") + 1, WINDOW).alias("words"), draw.alias("draw")).orderBy("draw").limit(WINDOWS)
    keyed = drawn.withColumn("key", F.xxhash64("draw"))
    train = docs.where("split = 'train'").select(F.col("doc_id").alias("id"), "words")
    hits = leakage.window_hits(keyed.select("key", "words"), train, WINDOW)
    return keyed.select("doc_id", "start", "key").join(hits, "key").select("doc_id", "start", "places", F.col("texts").alias("documents"))


LENGTH = 16


def _read_back(noise: float):
    @F.pandas_udf("struct<plain: boolean, valid: boolean, exact: boolean, kept_valid: boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for words in batches:
            whole = [w.encode() for w in words]
            rows = []
            for at in range(0, len(whole), 256):
                some = whole[at : at + 256]
                codes = codec.encode(some, LENGTH)
                if noise:
                    for i, w in enumerate(some):  # the same for equal words, wherever they are
                        codes[i] += noise * np.random.default_rng(list(w)).standard_normal(codes[i].shape)
                free, _ = codec.decode(codes)
                held = codec.decode_utf8(codes, np.array([min(len(w), LENGTH) for w in some]))
                for w, f, h in zip(some, free, held, strict=True):
                    want = w[:LENGTH].decode(errors="ignore").encode()
                    rows.append((f == w[:LENGTH], _valid(f), h == want, _valid(h)))
            yield pd.DataFrame(rows, columns=["plain", "valid", "exact", "kept_valid"])

    return run


def _valid(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words through byte codes of 16 positions, without noise and with: how many come back by columns alone and held to UTF-8, and how many of either are valid."""
    ship(spark)
    types = _words(_documents(spark, sf_dir)).select("word", F.least(F.octet_length("word"), F.lit(LENGTH + 1)).alias("bytes"))
    read = [types.select("bytes", F.lit(noise).alias("noise"), _read_back(noise)("word").alias("r")) for noise in (0.0, 4.0)]
    sums = [F.count(F.when(F.col(f"r.{c}"), 1)).alias(c) for c in ("plain", "valid", "exact", "kept_valid")]
    return read[0].union(read[1]).groupBy("noise", (F.col("bytes") > LENGTH).alias("cut")).agg(F.count(F.lit(1)).alias("types"), *sums)


def vector_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of all embeddings' squared length is lost in fewer dimensions when they are recovered with the least norm, and the same matrix's ridge inverse."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    total, n = gram.gram(rows, "embedding", size)
    out = []
    for k in sorted({max(1, size * i // 8) for i in (1, 2, 4, 6, 8)} if size else []):
        r, q = gram.recovery(total, k), gram.ridge(total, float(k))
        out.append((k, n, round(r["lost"], 6), round(r["condition"], 3), round(q["dimensions"], 4), round(q["condition"], 2)))
    return spark.createDataFrame(out, "dimensions int, vectors long, lost double, condition double, effective_dimensions double, ridge_condition double")


def ledger_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of ``events`` written in two halves with a checkpoint between, a crash that leaves records without a version and a version too many, restored and finished: its sums by lane, and how many versions it took."""
    steps = spark.sql(_steps(Spark()).replace("{events}", "{events_}"), events_=spark.read.parquet(f"{sf_dir}/events.parquet"))
    book = ledgers.Ledger(spark, scratch(spark, "ledger"), "step long, lane string, branch long, tokens long")
    steps = steps.select("step", "lane", "branch", "tokens")
    half = (steps.agg(F.max("step")).first()[0] or 0) // 2
    first, second = steps.where(f"step <= {half}"), steps.where(f"step > {half}")
    book.append(first)
    bound = {"plan": "mixed", "source": "events"}
    kept = ledgers.checkpoint(book, ["lane"], "tokens", bound)
    book.append(second.where("step % 2 = 0"))
    book.write(second)  # the crash: written, never committed
    problems = ledgers.restore(book, kept, bound)
    if problems:
        raise RuntimeError("; ".join(problems))
    book.append(second)
    return book.read().groupBy("lane").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").cast("long").alias("tokens"), F.max("step").alias("last_step")).withColumn("versions", F.lit(book.version()))


TOKEN_QUERIES: dict = {f.__name__: f for f in (bpe_merges, byte_merges, window_leakage, codec_round_trip, vector_recovery, ledger_restore)}

_WORDED = f"select doc_id, split, {Duck().words('text')} as words from ({_docs(Duck()).replace('{documents}', 'documents')}) d"
TOKEN_SQL: dict[str, str] = {
    "window_leakage": f"""with docs as materialized ({_WORDED}),
    every as (select doc_id, words, unnest(range(0, cast(len(words) as bigint) - {WINDOW - 1}, 16)) as start from docs where split = 'eval' and len(words) >= {WINDOW}),
    drawn as (select doc_id, start, array_to_string(list_slice(words, start + 1, start + {WINDOW}), ' ') as w from every order by sha256(doc_id || ':' || start) limit {WINDOWS}),
    train as (select doc_id, array_to_string(list_slice(words, i + 1, i + {WINDOW}), ' ') as w from (select doc_id, words, unnest(range(0, cast(len(words) as bigint) - {WINDOW - 1})) as i from docs where split = 'train' and len(words) >= {WINDOW}) x)
    select d.doc_id, d.start, count(t.w) as places, count(distinct t.doc_id) as documents from drawn d left join train t on t.w = d.w group by d.doc_id, d.start""",
    "ledger_restore": f"select lane, count(*) as records, cast(sum(tokens) as bigint) as tokens, max(step) as last_step, 4 as versions from ({_steps(Duck()).replace('{events}', 'events')}) s group by lane",
}
