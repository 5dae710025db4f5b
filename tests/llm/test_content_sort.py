"""op11: equal texts against a dictionary of whole normalised texts, with copies that are dealt out in pieces."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tessera.llm import content_sort
from tessera.llm.content_sort import equal_texts
from tessera.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, keep_id string, h int, t string, piece int"


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def held_to(rows, got):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    assert len(got) == len(rows)
    kept = defaultdict(list)
    for r in got:
        t = norm(r["text"])
        ids = [i for i in groups[t] if i is not None]
        assert r["keep_id"] == min(ids, default=None) and r["group_size"] == len(groups[t])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        if r["kept"]:
            kept[t].append(r["doc_id"])
    assert {t: [min((i for i in ids if i is not None), default=None)] for t, ids in groups.items()} == kept


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " ", "\t\n ", "a  b", "a b", "a\nb", "A b", "a b ", " a b", "a b", "a b", "a\x1cb", "é", "é"] * 3
    texts += [f"{'x' * 80} {i % 40}" for i in range(300)]  # alike in the first bytes
    texts += ["copy " * 30] * 900 + ["long " * 60000] * 9
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i if i % 97 else None, t, "keep", 1, "t", 2) for i, t in zip(ids, texts, strict=True)] + [(5, "copy " * 30, "", 0, "", 0)] * 3


def test_whole_groups(spark, rows):
    held_to(rows, equal_texts(spark.createDataFrame(rows, SCHEMA), carry=["text"]).collect())


def test_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(content_sort, "SPLIT_ROWS", 8)
    monkeypatch.setattr(content_sort, "SPLIT_BYTES", 100000)
    held_to(rows, equal_texts(spark.createDataFrame(rows, SCHEMA).repartition(7), carry=["text"]).collect())


def test_one_hash_is_not_one_text(spark, rows, monkeypatch):
    """All texts share a hash of two values: contents alone decide."""
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda *c: content_sort.F.length(content_sort.F.coalesce(c[0].cast("string") if not isinstance(c[0], str) else content_sort.F.col(c[0]).cast("string"), content_sort.F.lit(""))).cast("long") % 2)
    monkeypatch.setattr(content_sort, "SPLIT_ROWS", 100)
    held_to(rows, equal_texts(spark.createDataFrame(rows, SCHEMA), carry=["text"]).collect())


def test_empty_table_and_names(spark):
    assert equal_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        equal_texts(spark.createDataFrame([], SCHEMA), carry=["keep_id"])


def test_registered(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_content_sort"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, got.collect())) == sorted(map(str, equal_texts(spark.createDataFrame(rows, SCHEMA)).collect()))
