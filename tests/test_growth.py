"""Queries whose work grew faster than their input."""

import time

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import nearest
from tessera.plans import languages
from tessera.plans.cleaning import _scripts
from tessera.plans.dialect import Spark
from tessera.plans.registry import QUERIES
from tessera.sources import files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, texts):
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_nearest_vectors_in_blocks(spark, tmp_path, monkeypatch):
    """Joined rows aren't one for each pair; copies, nulls, other lengths and repeated ids as SQL has them."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(100, [1.0, 2.0, 3.0, 4.0]), (301, [1.0, 2.0, 3.0, 4.0]), (400, None), (500, [1.0, None, 0.0, 0.0]), (600, [5.0]), (700, [5.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(nearest, "PART", 3)
    query = QUERIES["nearest_separation"](spark, str(tmp_path))
    assert "zip_with" not in query._jdf.queryExecution().optimizedPlan().toString()
    got = {r["vec_id"]: (r["nearest"], r["equal_vectors"]) for r in query.collect()}
    vectors = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v]
    for q in (0, 100, 200, 400, 500, 600, 700):
        gaps = [((a - b) ** 2).sum() for i, a in vectors if i == q for j, b in vectors if j != q and len(a) == len(b)]
        near, equal = got.pop(q)
        assert equal == sum(g < 1e-9 for g in gaps) and abs(near - min(gaps, default=0.0) ** 0.5) < 1e-4  # without a distance SQL's greatest says 0
    assert not got


def test_licence_in_long_lines(spark, tmp_path):
    """A line is read once, not from each of its characters."""
    folder = documents(spark, tmp_path, ["a" * 200_000, "b" * 200_000 + " MIT License", "x\r y licence\nMIT License", None])
    start = time.time()
    got = {r["doc_id"]: (r["licence"], r["verdict"]) for r in QUERIES["licensed_documents"](spark, folder).collect()}
    assert time.time() - start < 20
    assert got == {0: (None, "no licence"), 1: ("mit", "taken"), 2: ("other", "not permissive"), 3: (None, "no licence")}


def test_numbers_of_long_texts(spark, tmp_path):
    """All digits of a text aren't made again for each number; an odd byte at the end is no number."""
    folder = documents(spark, tmp_path, ["word " * 60_000, "", None])
    start = time.time()
    got = {r["doc_id"]: (r["bytes"], r["total"]) for r in QUERIES["uint16_round_trip"](spark, folder).collect()}
    assert time.time() - start < 20
    assert got == {0: (120_000, 240_000), 1: (0, 0), 2: (None, 0)}
    odd = spark.createDataFrame([(bytearray([1, 2, 255, 255, 7]),), (None,)], "data binary").select(files.from_uint16(F.col("data")).alias("n"))
    assert [r["n"] for r in odd.collect()] == [[513, 65535], []]


def test_letters_are_counted_without_lists(spark, tmp_path):
    texts = ["plain words", "कहानी abc", "سلام ݐ é 😀", "", None, "০ক ௐ x"]
    rows = spark.sql(_scripts(Spark()).replace("{documents}", "{docs}"), docs=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")))
    assert "regexp_count" not in _scripts(Spark())
    got = {r["doc_id"]: (r["Devanagari"], r["Bengali"], r["Tamil"], r["Arabic"], r["Latin"]) for r in rows.collect()}
    assert got == {0: (0, 0, 0, 0, 10), 1: (5, 0, 0, 0, 3), 2: (0, 0, 0, 5, 0), 3: (0,) * 5, 4: (None,) * 5, 5: (0, 2, 1, 0, 1)}


def test_cues_are_not_put_together_of_two_runs(spark, tmp_path):
    """Two Marathi words make a text Marathi; their halves apart don't, nor do other scripts between them."""
    folder = documents(spark, tmp_path, ["मला नाही", "म x ला ना, ही", "मला x नाही"])
    assert "contains(text" not in languages.language_detect(Spark())
    assert {r["doc_id"]: r["lang"] for r in QUERIES["language_detect"](spark, folder).collect()} == {0: "mr", 1: "hi", 2: "mr"}


def test_token_batches_are_bounded(spark):
    """Queries of tokens bound what Python's side holds at once, in rows and bytes."""
    for name in ("bpe_round_trip", "bpe_fertility"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 16 << 20


def test_profiles_are_dealt_once(spark):
    """Words of a text aren't dealt by (document, word): heads of texts are, by document."""
    plan = QUERIES["token_profile"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "hashpartitioning(doc_id" in plan


def test_slots_cut_texts_once(spark):
    """Bands and decisions of all documents are written once, not worked out anew wherever slots read them; what is left are the lanes with words."""
    for name in ("slot_gates", "filled_slots", "batch_accounts"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(text") <= 2
