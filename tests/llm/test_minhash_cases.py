"""op10 as registered, on one cluster around the threshold, repeated and null ids, long texts and clashing columns."""

import itertools
import random

import numpy as np

from tessera.llm import minhash, suffix_dedup

DOCS = "doc_id long, text string, kept boolean, component_id long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    template = [f"t{i}" for i in range(120)]

    def edited(n):
        w = list(template)
        for i in r.sample(range(120), n):
            w[i] = f"e{r.randrange(40)}"  # few words, so that edits are shared
        return " ".join(w)

    texts = [edited(r.randint(0, 9)) for _ in range(120)] + ["A b  c D", "a B c d", "x", "", None, None] + [" ".join(f"l{i % 9000}" for i in range(30000))] * 2
    rows = [(i, t, None, -1) for i, t in enumerate(texts)] + [(3, texts[3], True, 5), (3, texts[3], True, 5)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    want = sorted((i, len(sets[i]), top(i), top(i) == i) for i in [*range(len(texts)), 3, 3])
    out = minhash.op10_minhash(spark, str(tmp_path))
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in out.collect()) == want
    assert len({top(i) for i in range(120)}) > 3  # some of the cluster are beyond the threshold


def test_empty_table_and_null_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    out = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f", None, 1), (7, "a b c d e f", None, 1), (None, "", None, 1)], DOCS))
    assert sorted(map(str, ((x.doc_id, x.component_id, x.kept) for x in out.collect()))) == sorted(map(str, [(None, 7, False), (7, 7, True), (None, None, True)]))


def test_odd_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 30, 500, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 7 :], rng.integers(0, 1 << 63, n // 7).astype(np.uint64)]))
        x, y = minhash.odd_sketch(a), minhash.odd_sketch(b)
        assert len(x) == len(y) and np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_cuts_keep_whole_characters(spark):
    passage = "é" * 30 + "ü�x" * 40
    df = spark.createDataFrame([(1, "aaa" + passage), (2, "bé" + passage + "�tail")], "doc_id long, text string")
    out = {x.doc_id: bytes(x.kept).decode() for x in suffix_dedup.cut_repeats(df, characters=True).collect()}
    assert out[2] == "bé�tail"
