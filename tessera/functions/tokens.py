"""Byte-fallback BPE by a vocabulary file: encode, decode and the vocabulary as a table. Nothing is trained here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(text: Column, path: str = VOCABULARY) -> Column:
    """Token ids of whole texts; null stays null, and an empty text has none. The file must be at ``path`` on every machine."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _processor(path)
        for b in batches:
            ids = [np.array(model.encode(x.as_py()), np.int32) if x.is_valid else None for x in b]  # one text's tokens are Python's numbers at a time
            yield pa.array(ids, pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of token ids; bytes that stand for one character are put together again."""

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _processor(path)
        for b in batches:
            yield pa.array([model.decode(x.as_py()) if x.is_valid else None for x in b], pa.string())

    return run(ids)


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """A row for each id: surface with blanks for the mark of a word's start, and kind (byte, special, word start, inside)."""
    model = _processor(path)
    kinds = [(i, model.id_to_piece(i), model.is_byte(i), model.is_control(i) or model.is_unknown(i)) for i in range(model.vocab_size())]
    rows = spark.createDataFrame(kinds, "id int, piece string, is_byte boolean, is_special boolean")
    kind = F.when(F.col("is_byte"), "byte").when(F.col("is_special"), "special").when(F.col("piece").startswith("▁"), "word start").otherwise("inside")
    return rows.select("id", F.regexp_replace("piece", "▁", " ").alias("surface"), kind.alias("kind"))
