"""Sources, sinks and DataFrame queries against files written by hand and against plain Python."""

import hashlib
import json
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.plans.python_queries import PYTHON_SQL
from tessera.plans.registry import QUERIES
from tessera.sources import files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Texts, and what cleaning leaves of them, worked out by hand.
CLEANED = [
    ('e\u0301te\u0301  &amp; <b>bold</b>\n\n\n\nend ', '\xe9t\xe9 & bold \n\nend'),
    ('zero\u200bwidth\ufeff and \u0915\u094d\u200d\u0937 kept\u200c', 'zerowidth and \u0915\u094d\u200d\u0937 kept\u200c'),
    ('<|im_start|>user hi [/INST] <<SYS>> there [USER]', 'user hi > there'),
    ('\x01\x02 ', ''),
    ('', ''),
    (None, None),
    ('a\xa0\u3000b\r\nc', 'a b \nc'),
    ('&#8217;&lt;i&gt;x', '\u2019 x'),
]
TEXTS = [t for t, _ in CLEANED]


def _folder(spark, path, texts):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_clean_text(spark, tmp_path):
    got = {r["doc_id"]: r for r in QUERIES["clean_text"](spark, _folder(spark, tmp_path, TEXTS)).collect()}
    for i, (_, left) in enumerate(CLEANED):
        if left is None:
            assert got[i]["content_hash"] is None and got[i]["dropped"] is None
            continue
        assert got[i]["content_hash"] == hashlib.sha256(left.encode()).hexdigest(), (i, left)
        assert got[i]["dropped"] == (left == "")
    assert got[1]["joiners"] == 2 and got[2]["markers"] == 4


def test_unicode_nfc(spark, tmp_path):
    got = {r["doc_id"]: r for r in QUERIES["unicode_nfc"](spark, _folder(spark, tmp_path, TEXTS)).collect()}
    assert got[0]["changed"] and not got[1]["changed"]
    assert got[0]["nfc_hash"] == hashlib.sha256(unicodedata.normalize("NFC", TEXTS[0]).encode()).hexdigest()


def test_checksum_windows(spark, tmp_path):
    rng = random.Random(1)
    words = {"".join(rng.choices("abé漢", k=rng.randint(1, 9))) + tail for tail in ("", "x", "yy") for _ in range(300)}
    got = {tuple(r) for r in QUERIES["checksum_collisions"](spark, _folder(spark, tmp_path, [" ".join(words)])).collect()}

    def overflow(b, k):
        return b if len(b) <= k else b[: k - 1] + bytes([zlib.crc32(b[k - 1 :]) & 255])

    def ends(b, k):
        back, front = (k - 1) // 2, k - 1 - (k - 1) // 2
        return b if len(b) <= k else b[:front] + b[len(b) - back :] + bytes([zlib.crc32(b[front : len(b) - back]) & 255])

    want = set()
    for name, key in (("overflow_hash", overflow), ("both_ends_hash", ends)):
        for k in (8, 16, 32):
            groups = [n for n in Counter(key(w.encode(), k) for w in words).values() if n > 1]
            if groups:
                want.add(("en", name, k, len(groups), sum(groups), sum(groups)))
    assert got == want and got


def test_pca(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack([np.asarray(v, float) for v in rows.embedding])
    x -= x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(x.T))
    got = QUERIES["pca_2d"](spark, sf).orderBy("vec_id").toPandas()
    for name, axis in (("x", axes[:, -1]), ("y", axes[:, -2])):
        axis = axis if axis[np.abs(axis).argmax()] > 0 else -axis
        assert np.allclose(got[name], x @ axis, atol=1e-3)


def test_json_lines(spark, tmp_path):
    p = tmp_path / "lane.jsonl"
    p.write_text("\n".join([json.dumps({"id": 1, "text": "a"}), "", "  ", "{broken", json.dumps({"id": 2, "text": None}), "[1, 2"]) + "\n")
    rows = files.read_json_lines(spark, str(p), "id long, text string").where("id is not null").collect()
    assert sorted((r["id"], r["text"]) for r in rows) == [(1, "a"), (2, None)]
    assert {r["value"] for r in files.malformed_lines(spark, str(p), "id long, text string").collect()} == {"{broken", "[1, 2"}
    files.append_json_lines(spark.range(3), f"{tmp_path}/out")
    files.append_json_lines(spark.range(2), f"{tmp_path}/out")
    assert files.read_json_lines(spark, f"{tmp_path}/out", "id long").count() == 5


def test_trees(spark, tmp_path):
    for name in ("hindi", "toxic/matrix"):
        spark.createDataFrame([("q " + name,)], "question string").write.parquet(f"{tmp_path}/{name}")
    got = files.parquet_tree(spark, str(tmp_path)).withColumn("source", files.source_of(F.col("file"))).collect()
    assert {r["source"] for r in got} == {"hindi", "matrix"} and files.parquet_tree(spark, str(tmp_path), 1).count() == 1
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    assert files.holdout(spark, str(tmp_path)).count() == 2


def test_capped(spark):
    rows = [(0, "a", "xx"), (1, "a", "  xx\r"), (2, "a", "yyy"), (3, "a", "zz"), (1500, "a", "w"), (0, "b", "q" * 50), (1, "b", "r"), (2, "b", None)]
    got = {(r["lane"], r["key"], r["start"]) for r in files.capped(spark.createDataFrame(rows, "k long, l string, t string"), "l", "k", "t", 6).collect()}
    assert got == {("a", 0, 0), ("a", 2, 2), ("a", 3, 5), ("b", 0, 0)}


def test_uint16(spark, tmp_path):
    numbers = [0, 1, 255, 256, 65535]
    df = spark.createDataFrame([(numbers,), ([],)], "x array<int>").select(files.to_uint16(F.col("x")).alias("d"))
    got = [bytes(r["d"]) for r in df.collect()]
    assert np.frombuffer(got[0], "<u2").tolist() == numbers and got[1] == b""
    (tmp_path / "a.bin").write_bytes(np.asarray(numbers, "<u2").tobytes())
    assert files.read_uint16(spark, str(tmp_path)).head()["numbers"] == numbers


@pytest.mark.parametrize("name", sorted(PYTHON_SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "clicks"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got, want = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(PYTHON_SQL[name]).df()
    rows = lambda f: sorted(f[sorted(f.columns)].astype(str).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_trees_and_broken_lines(spark, tmp_path):
    docs = [(1, "abc", "en", "a", 3), (2, "de", "en", "a", 2), (3, None, "en", None, 0), (4, "f", "en", "b", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 0, 1), (2, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["source"], r["toxic_source"]): (r["docs"], r["chars"]) for r in QUERIES["source_tree"](spark, str(tmp_path)).collect()}
    assert got == {("a", False): (1, 3), ("a", True): (1, 2), ("none", False): (1, 0), ("b", False): (1, 1)}
    clicks = [(1, "view", '{"k": 1}'), (2, "view", '{"k": 1'), (3, None, None), (4, "click", "{}"), (None, "view", "{}")]
    spark.createDataFrame(clicks, "click_id long, kind string, props string").write.parquet(f"{tmp_path}/clicks.parquet")
    assert {r["kind"]: (r["rows"], r["broken"]) for r in QUERIES["broken_lines"](spark, str(tmp_path)).collect()} == {"view": (1, 1), "none": (0, 1), "click": (1, 0)}
