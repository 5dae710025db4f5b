"""Operators against brute force, round trips and edge cases."""

import itertools
import random

import numpy as np

from tessera.llm import cover_tree, gif, kneser_ney, longest_match, minhash, mixing, packing, sharding, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def sample(n=60, seed=1):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "é", "on"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(n)]
    base += [base[3], base[4] + " tail", "", "x"]
    return [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(base)] + [(1000, None, "s1")]


def test_rendezvous_moves_into_the_new_shard_only(spark):
    out = sharding.shard_records(make_docs(spark, sample()).select("doc_id"), "doc_id", [1.0] * 5, [1.0] * 6).toPandas()
    moved = out[out.shard != out.grown_shard]
    assert (moved.grown_shard == 5).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_rendezvous_of_an_empty_table(spark):
    assert sharding.shard_records(spark.createDataFrame([], "doc_id long, shard string"), "doc_id", [1.0, 0.0]).count() == 0


def test_gif_round_trips_and_growing_tables():
    rng = np.random.default_rng(0)
    for n, most in itertools.product((64, 64 * 4, 64 * 300, 64 * 3000), (1, 3, 50, 256)):
        data = rng.integers(0, most, n).astype(np.uint8).tobytes()
        frames = gif.decode(gif.encode(gif.as_frames(data)))
        assert b"".join(f.indices.tobytes() for f in frames) == data
    assert len(gif.payload_of(b"")) == 64 and len(gif.payload_of(b"a" * 64)) == 64


def test_gif_disposal_restores_the_background():
    one, two = np.full((2, 2), 7, np.uint8), np.full((1, 1), 9, np.uint8)
    frames = gif.decode(gif.encode([one, two], disposal=2))
    assert frames[0].rgba[1, 1].tolist() == [7, 7, 7, 255]
    assert frames[1].rgba[0, 0].tolist() == [9, 9, 9, 255] and frames[1].rgba[1, 1].tolist() == [0, 0, 0, 0]


def test_repeats_equal_brute_force(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcdef ") for _ in range(40))
    rows = sample(30, 2) + [(500, "q" * 90, "s"), (501, "z" + passage + "1", "s"), (502, "y" + passage + "2" + passage, "s")]
    got = suffix_dedup.cut_repeats(make_docs(spark, rows), length=30)
    want = suffix_dedup.brute([(i, (t or "").encode()) for i, t, _ in rows], 30)
    for row in got.collect():
        assert (row.n_bytes, row.n_removed, row.n_spans) == want[row.doc_id][:3]


def test_near_duplicates_equal_brute_force(spark):
    rows = sample()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(spark, rows), words_per_shingle=4).collect()}
    sets = {i: {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if (w := (t or "").lower().split()) else set() for i, t, _ in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in sets}


def test_cover_tree_finds_what_all_pairs_give():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6))
    x[100:] = x[:50] + rng.normal(size=(50, 6)) * 0.1
    i, j = cover_tree.links_between(x, x, 0.9, True)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(a, b) for a, b in itertools.combinations(range(150), 2) if u[a] @ u[b] >= 0.9}
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == want


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2)]
    out = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {1: (1, 1), 2: (1, 1)} | {i: (0, i) for i in range(3, 9)}


def test_longest_match_equals_greedy():
    vocabulary = ["a", "ab", "abc", "bcd", "cde", "▁", "▁ab", "xyz", "x"]
    machine = longest_match.Automaton(vocabulary)

    def greedy(word):
        n = at = 0
        while at < len(word):
            size = max((len(v) for v in vocabulary if word.startswith(v, at)), default=0)
            n += 1 if size else len(word[at].encode())
            at += size or 1
        return n

    r = random.Random(0)
    for _ in range(3000):
        word = "▁" + "".join(r.choice("abcdexyzé") for _ in range(r.randint(0, 9)))
        assert machine.count(word) == greedy(word), word


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 4}") for i in range(400)] + [(900, None, None), (901, "w", None)]
    from pyspark.sql import functions as F

    run = lambda n: mixing.mix_sources(make_docs(spark, rows).repartition(n), "doc_id", "source", F.regexp_count("text", F.lit(mixing.WORD))).toPandas().sort_values("doc_id")
    a, b = run(1), run(5)
    assert (a.copies.to_numpy() == b.copies.to_numpy()).all() and a.copies.max() <= 2
    assert abs(a.groupby("source", dropna=False).target.first().sum() - 1.5 * a["size"].sum()) < 1e-6
    for _, g in a.groupby("source", dropna=False):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 17


def test_packing_keeps_conflicts_apart(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * (i % 50), f"s{i % 2}") for i in range(300)] + [(999, None, None)]
    df = make_docs(spark, rows)
    out = packing.pack(df, "doc_id", F.regexp_count("text", F.lit("w")), "source", F.col("n_chars") % 11, capacity=64, per_source=2).toPandas()
    assert out.groupby("bin").n_words.sum().max() <= 64
    assert out.groupby("doc_id").n_words.sum().to_dict() == {i: (t or "").count("w") for i, t, _ in rows}
    whole = out[out.n_words < 64].merge(df.toPandas(), on="doc_id")
    assert whole.groupby(["bin", whole.n_chars % 11]).size().max() == 1
    assert whole.groupby(["bin", "source"]).size().max() <= 2


def test_kneser_ney_sums_to_one(spark):
    docs = make_docs(spark, sample())
    vocabulary = kneser_ney.learn_vocabulary(docs)
    keys, p, gamma, two = kneser_ney.log_table(*kneser_ney.fit(kneser_ney.count_trigrams(docs, vocabulary)))
    dense = (gamma[:, None] + two.reshape(256, 256)[np.arange(65536) % 256]).reshape(-1)
    dense[keys] = p
    sums = np.exp(dense.astype(float)).reshape(-1, 256).sum(1)
    assert np.allclose(sums[np.unique(keys >> 8)], 1, atol=1e-4)


def test_toxicity_tolerates_gaps(spark):
    r = random.Random(2)
    plain = ["the", "house", "river", "stone", "green", "walk", "table", "window"]
    rows = [(" ".join([*(r.choice(plain) for _ in range(12)), *(["wretchling"] if y else [])]), y) for y in (0, 1) for _ in range(60)]
    model = toxicity.fit(rows)
    docs = make_docs(spark, [(0, "the house w r e t c h l i n g river", "a"), (1, "green wret.chxling walk", "a"), (2, "the green river", "a"), (3, "", "a"), (4, None, "a")])
    score = {x.doc_id: x.score for x in toxicity.score_texts(docs, model).collect()}
    assert min(score[0], score[1]) > 0.5 > max(score[2], score[3], score[4])
