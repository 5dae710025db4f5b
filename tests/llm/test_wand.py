"""op12: the best documents against every document scored, with small shards, windows and blocks of queries."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import wand
from tessera.llm.queries import QUERIES
from tessera.llm.wand import search_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score string, item string"


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    full = [b for _, b in bags if b]
    n_docs, total = len(full), sum(sum(b.values()) for b in full)
    df = Counter(t for b in full for t in b)
    out, asked = [], {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, query in asked.items():
        scored = []
        for i, bag in bags:
            n = sum(bag.values())
            m = 10 + 90 * n * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in query if bag[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(docs, items, k=10):
    out = search_documents(docs, items, k=k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "éa", "ß", "漢字", "x_y", "a-b", "\x01c", "n o"]
    texts = [rng.choice([" ", ". ", "\n"]).join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 60))) for _ in range(700)]
    texts += [None, "", " .,;", "W1 w1 w1", "longer " * 20000 + "w59"] + [texts[3]] * 120
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = [(i if i % 50 else None, t, "score", "item") for i, t in zip(ids, texts, strict=True)] + [(7, texts[3], "", ""), (7, texts[4], "", "")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(12)] + [(3, "w5 w5 more"), (None, "w9 w2"), (50, ""), (51, None), (52, "unheard"), (53, texts[3])]
    return docs, items


@pytest.mark.parametrize(("shard", "window", "k"), [(16384, 1024, 10), (40, 8, 3)])
def test_all_documents_scored(spark, tables, monkeypatch, shard, window, k):
    docs, items = tables
    monkeypatch.setattr(wand, "SHARD_DOCS", shard)
    monkeypatch.setattr(wand, "WINDOW_DOCS", window)
    monkeypatch.setattr(wand, "SHARD_POSTINGS", shard * 10)
    assert got(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(items, "item_id long, text string"), k) == brute(docs, items, k)


def test_blocks_of_queries(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(wand, "BLOCK_BYTES", 500)
    assert got(spark.createDataFrame(docs, SCHEMA).coalesce(2), spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_windows_without_a_pivot_are_not_read():
    """The heap's threshold rules out all windows but the one with the best document, and the documents below it there."""
    doc = np.arange(64)
    shard = wand.Shard(np.concatenate([doc, [40]]), np.concatenate([np.zeros(64, int), [1]]), np.concatenate([np.full(64, 5), [9]]), 64, 2)
    found, top = [], np.array([0, 0])
    assert shard.search(np.array([0, 1]), 6, found, top, 2) == 6
    assert [x.tolist() for x in found[0]] == [[40], [14]] and len(found) == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(docs, items) == [] and got(docs, some) == []
    assert got(spark.createDataFrame([(1, "a", "", "")], SCHEMA), items) == []


def test_registered(spark, tables, tmp_path):
    docs, items = tables
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, QUERIES["op12_wand"](spark, str(tmp_path)).collect()), key=str) == brute(docs, items)
