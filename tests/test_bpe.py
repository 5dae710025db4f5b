"""Merges against the plain loop that takes one pair after another."""

import random
import time
from collections import Counter

import pytest

from tessera.operators.bpe import MARK, learn_merges


def loop(words, merges, kind, least=1):
    counts = Counter()
    for w, n in words:
        if w is not None:
            counts[w] += n
    split = {w: list(MARK + w) if kind == "chars" else [chr(b) for b in (" " + w).encode()] for w in counts}
    done = []
    while len(done) < merges:
        pairs = Counter()
        for w, s in split.items():
            for p in zip(s, s[1:], strict=False):
                pairs[p] += counts[w]
        pairs = {p: n for p, n in pairs.items() if n >= least}
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        done.append((a, b, n))
        for w, s in split.items():
            out = []
            for c in s:
                if len(out) and out[-1] == a and c == b and not (out[-1:] == ["\0"]):
                    out[-1:] = ["\0", a + b]  # a mark keeps a merged symbol from merging again
                else:
                    out.append(c)
            split[w] = [c for c in out if c != "\0"]
    return done


@pytest.mark.parametrize(("kind", "merges"), [("chars", 30), ("bytes", 12)])
def test_merges_of_the_documents(spark, kind, merges):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = Counter(w for r in text.collect() for w in (r["text"] or "").split())
    words = [(w, n) for w, n in rows.items() if "\n" not in w]
    assert learn_merges(spark.createDataFrame(words, "word string, n long"), merges, kind) == loop(words, merges, kind)


def test_ties_runs_and_rare_pairs(spark):
    rng = random.Random(4)
    words = [("aaaa", 3), ("aaa", 2), ("a", 9), ("", 5), (None, 7), ("abab", 4), ("abab", 1), ("éé漢", 2), ("cd", 5), ("dc", 5)] + [("".join(rng.choices("abcd", k=rng.randint(1, 9))), rng.randint(1, 4)) for _ in range(80)]
    df = spark.createDataFrame(words, "word string, n long")
    assert learn_merges(df, 25) == loop(words, 25, "chars")
    assert learn_merges(df, 500, least=30) == loop(words, 500, "chars", 30)
    assert learn_merges(df.where("false"), 5) == []


def test_a_merge_is_one_pass_over_numbers(spark):
    """A large vocabulary isn't split into a row for each pair of neighbours, and no word is merged symbol by symbol."""
    rng = random.Random(7)
    words = [("".join(rng.choices("abcdefghijklmnop", k=12)), 1 + i % 3) for i in range(150_000)]
    df = spark.createDataFrame(words, "word string, n long").repartition(8).cache()
    learn_merges(df, 1)
    start = time.time()
    got = learn_merges(df, 16)
    assert time.time() - start < 20
    assert got[:2] == loop(words, 2, "chars")
    assert learn_merges(df.limit(300), 40) == loop([(r["word"], r["n"]) for r in df.limit(300).collect()], 40, "chars")  # more than are held back
