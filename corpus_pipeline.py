"""From raw documents to packed bins: toxicity, near-duplicates, repeats, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again for the next one; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, mixing, packing, suffix_dedup, toxicity
from tessera.llm.common import WORD, among, deleted, noted, numbered, prepare, settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, a hash of the whole row, its nulls told apart: rows of one key are equal."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("key"))


def _taken(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows as often as ``wanted`` (key, m: rows of the key, copies: of all of them, above 0) says; only repeated rows are numbered."""
    once = keyed.join(wanted.where("m = 1").select("key", "copies"), "key")
    repeated = wanted.where("m > 1")
    # a bitmap of the keys lets few other rows through, so that texts aren't shuffled a second time
    again = numbered(among(keyed, "key", repeated.select("key")).join(repeated, "key"), ["key"], "i")
    share = F.floor(F.col("copies") / F.col("m")) + (F.col("i") < F.col("copies") % F.col("m")).cast("long")
    both = once.select(*COLUMNS, "copies").union(again.select(*COLUMNS, share.alias("copies"))).where("copies > 0")
    return both.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. The model is fitted on this stage's labelled rows, a fifth held out.

    Null and empty texts are scored as texts without units and stay, as do repeated rows and ids. Other columns are left
    out. Without labels, or of an empty table, the model is that of no texts.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs.select(COLUMNS), model).where("score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at similarity 0.8 on five-word shingles, one stays: with the least id (null last), of those the least key.

    Rows without words (null, empty, white space) all stay, repeated ones too. Other columns than those of ``documents`` are
    left out. An empty table stays empty.
    """
    keyed = _keyed(docs)

    def wanted() -> DataFrame:
        classes = minhash.near_duplicates(keyed, words_per_shingle=5, percent=80, key_col="key")
        kept = classes.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("n_shingles").alias("n_shingles"))
        return kept.select("key", "m", F.when(F.col("n_shingles") > 0, F.lit(1).cast("long")).otherwise(F.col("m")).alias("copies"))

    return _taken(keyed, settled(wanted))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier are cut out; characters cut in half go with them.

    Earlier is the smaller id (null last), then the smaller SHA-256 of the text. Every row stays, texts that are not cut as
    they are, null too; n_chars is the new length. Other columns are left out; an empty table stays empty.
    """
    cut = suffix_dedup.cut_repeats(docs.select(COLUMNS), characters=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 150 % of all words, sources weighing 5, 2, 1, at most twice each.

    A null source is one of its own; rows without words are in no mix and go. Repeated rows share their copies evenly.
    Other columns are left out; an empty table stays empty.
    """
    keyed = _keyed(docs)

    def wanted() -> DataFrame:
        mixed = mixing.mix_sources(keyed, "key", "source", F.regexp_count("text", F.lit(WORD)))
        return mixed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("copies").alias("copies")).where("copies > 0")

    return _taken(keyed, settled(wanted))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in bins of 2,048 words, no two of one text in a bin; a row without words is one empty piece, repeated rows are packed apart."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("mixing", mix_to_targets), ("packing", pack_bins)]

#: The stages rest on a fitted model, hashes and draws; tests hold near_duplicates and mixing on null
#: ids and repeated rows, the operators of the others by brute force or examples, and the whole pipeline not at all.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with noted() as made:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        deleted(spark, [*made, *([f"{folder}/{i - 1}-{STAGES[i - 1][0]}"] if i else [])])  # the stage is written: nothing reads them any more
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
