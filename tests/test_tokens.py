"""Tokens against the library called on the driver."""

import pytest

from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.plans.registry import QUERIES

sentencepiece = pytest.importorskip("sentencepiece")
SF = "/root/testdata/sf0.001"


def test_encode_and_decode(spark):
    texts = ["plain words", "", None, "漢字 😀 é", "  two  blanks\nline", "क्‍ष" * 500]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", tokens.encode(F.col("t")).alias("ids"))
    got = {r["i"]: r for r in rows.select("*", tokens.decode(F.col("ids")).alias("again")).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.VOCABULARY)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == (None if t is None else model.encode(t))
        if t is not None:
            assert "".join(got[i]["again"].split()) == "".join(t.split())


def test_queries(spark):
    docs = QUERIES["bpe_round_trip"](spark, SF).collect()
    assert len(docs) == 200 and all(r["faithful"] and r["token_types"] <= r["tokens"] for r in docs)
    langs = {r["lang"]: r["tokens"] for r in QUERIES["bpe_fertility"](spark, SF).collect()}
    assert sum(langs.values()) == sum(r["tokens"] for r in docs)
    spans = {}
    for r in QUERIES["span_tokens"](spark, SF).orderBy("conv_id", "turn").collect():
        assert r["start"] == spans.get(r["conv_id"], 0)
        spans[r["conv_id"]] = r["end"]
    kinds = {r["kind"]: r["ids"] for r in QUERIES["vocabulary_kinds"](spark, SF).collect()}
    assert kinds["byte"] == 256 and sum(kinds.values()) == 32000
