"""Kneser-Ney over real words against brute force."""

import math
import os
import random
from collections import Counter, defaultdict

from tessera.llm import common, kneser_ney, word_ngrams

ROWS = "row long, learn boolean, text string"


def brute(learning):
    """p(a, b, c) by the textbook, from dictionaries."""
    three = Counter(g for t in learning for g in grams(t))
    two = Counter((b, c) for a, b, c in three)
    one = Counter(c for b, c in two)

    def cuts(counts):
        n1, n2, n3, n4 = (max(sum(n == i for n in counts.values()), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        return lambda n: d[min(n, 3) - 1] if n else 0.0

    def order(counts, key):
        cut, total, off = cuts(counts), defaultdict(int), defaultdict(float)
        for g, n in counts.items():
            total[key(g)] += n
            off[key(g)] += cut(n)
        return lambda g, low: (counts[g] - cut(counts[g])) / total[key(g)] + off[key(g)] / total[key(g)] * low if key(g) in total else low

    p1, p2, p3 = order(one, lambda g: ()), order(two, lambda g: g[0]), order(three, lambda g: g[:2])
    return lambda a, b, c: p3((a, b, c), p2((b, c), p1(c, 1 / (len(one) + 1))))


def grams(text):
    w = ["", "", *(text or "").split(), ""]
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]


def test_perplexity_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]  # more words than the folded model has symbols
    texts = [" ".join(vocabulary[min(int(r.expovariate(0.02)), 399)] for _ in range(r.randint(0, 40))) for _ in range(80)] + ["", None, "never seen words", "w1 w2"]
    learn = [i % 3 != 0 and i < 80 for i in range(len(texts))]
    df = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(zip(learn, texts, strict=True))], ROWS).repartition(3)
    got = {x.row: x.perplexity for x in word_ngrams.perplexities(df).collect()}
    p = brute([t for x, t in zip(learn, texts, strict=True) if x])
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = math.exp(-sum(math.log(p(*g)) for g in grams(t)) / len(grams(t)))
        assert math.isclose(got[i], want, rel_tol=1e-9), i


def test_slices_add_up_and_leave_no_tables(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{min(int(r.expovariate(0.05)), 99)}" for _ in range(r.randint(0, 30))) for _ in range(40)] + [None, "new words"]
    df = spark.createDataFrame([(i, i % 2 == 0 and i < 40, t) for i, t in enumerate(texts)], ROWS)
    with common.noted() as made:
        got = {x.row: x.perplexity for x in word_ngrams.perplexities(df, parts=3).collect()}
    p = brute(texts[:40:2])
    for i, t in enumerate(texts):
        assert math.isclose(got[i], math.exp(-sum(math.log(p(*g)) for g in grams(t)) / len(grams(t))), rel_tol=1e-9), i
    assert sum(os.path.exists(path.removeprefix("file:")) for path in made) == 4  # words' probabilities and each slice's sums
    nothing = spark.createDataFrame([(1, False, "a b"), (2, None, None)], ROWS)
    assert {x.row: round(x.perplexity, 9) for x in word_ngrams.perplexities(nothing, parts=2).collect()} == {1: 1.0, 2: 1.0}


def test_tables_never_take_more_room_than_the_texts(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(f"word{min(int(r.expovariate(0.001)), 9999)}" for _ in range(300)) for _ in range(1500)]
    df = spark.createDataFrame([(i, i % 4 == 0, t) for i, t in enumerate(texts)], ROWS).coalesce(1)
    taken, plain = [], word_ngrams.saved

    def saved(table):
        out = plain(table)
        folder = os.path.dirname(out._table.removeprefix("file:"))
        held = {path: sum(e.stat().st_size for e in os.scandir(f"{folder}/{path}")) for path in os.listdir(folder)}
        taken.append(sum(held[path] for path in held if path not in before))
        return out

    common.prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    monkeypatch.setattr(word_ngrams, "saved", saved)
    assert word_ngrams.perplexities(df, parts=4).count() == len(texts)
    assert max(taken) < sum(map(len, texts))


def test_texts_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"word{i % 7} " * 20, "en") for i in range(50)], "doc_id long, text string, lang string").write.parquet(path)
    docs = spark.read.parquet(path)
    seen = []
    plain, word_ngrams.buffers = word_ngrams.buffers, lambda texts: seen.append(texts._jdf.queryExecution().executedPlan().toString()) or plain(texts)
    try:
        assert kneser_ney.classify(docs, docs.where("doc_id < 30").select("doc_id")).count() == 50
    finally:
        word_ngrams.buffers = plain
    assert seen and "Exchange" not in seen[0] and "Join" not in seen[0]


def test_shuffled_rare_words_are_told_from_prose(spark):
    r = random.Random(6)
    sentence = [["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(8)] for _ in range(150)]
    prose = lambda: " ".join(w for _ in range(12) for w in r.choice(sentence))

    def shuffled():
        w = prose().split()
        r.shuffle(w)
        return " ".join(w)

    rows = [(i, prose(), "en") for i in range(200)] + [(1000 + i, shuffled(), "en") for i in range(20)] + [(None, prose(), None), (3, prose(), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = kneser_ney.classify(docs, docs.where("doc_id < 150").select("doc_id")).collect()
    assert len(out) == len(rows)
    assert not any(x.kept for x in out if x.doc_id is not None and x.doc_id >= 1000)
    assert sum(x.kept for x in out if x.doc_id is None or x.doc_id < 1000) >= 190
