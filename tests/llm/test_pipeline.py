"""Pipeline stages on null ids, repeated rows and equal ids."""

from collections import Counter

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=30):
    return " ".join(f"w{seed}x{j}" for j in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(3)


def test_near_duplicates_keep_one_row_of_each_component(spark):
    near = text(6) + " tail"
    rows = [(1, text(1), "a"), (None, text(2), "a"), (None, text(3), "a"), (None, text(3), "a"), (4, text(4), "a"), (4, text(4), "a"), (4, text(4), "b"), (5, text(5), "a"), (5, text(9), "a"), (7, text(6), "a"), (6, near, "a"), (None, text(6), "a"), (8, "", "a"), (8, "", "a"), (None, None, None)]
    out = corpus_pipeline.drop_near_duplicates(spark, make(spark, rows), "").collect()
    got = Counter((x.doc_id, x.text) for x in out)
    assert got == Counter([(1, text(1)), (None, text(2)), (None, text(3)), (4, text(4)), (5, text(5)), (5, text(9)), (6, near), (8, ""), (8, ""), (None, None)])


def test_mixing_takes_the_copies_it_draws(spark):
    rows = [(i, text(i, 5 + i % 7), f"s{i % 3}") for i in range(60)] + [(100, text(100, 9), "s0")] * 20 + [(None, text(200 + i, 8), None) for i in range(10)] + [(100, text(101, 9), "s0")]
    docs = make(spark, rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    out = corpus_pipeline.mix_to_targets(spark, docs, "").collect()
    got = Counter()
    for x in out:
        got[x.source] += len(x.text.split())
    targets = {x.source: x.target for x in corpus_pipeline.mixing.mix_sources(docs, "doc_id", "source", corpus_pipeline.F.regexp_count("text", corpus_pipeline.F.lit(corpus_pipeline.WORD))).select("source", "target").distinct().collect()}
    assert got[None] > 0
    for s, target in targets.items():
        assert abs(got[s] - target) <= 11, (s, got[s], target)
    most = Counter((x.doc_id, x.text) for x in out)
    have = Counter((i, t) for i, t, _ in rows)
    assert all(n <= 2 * have[k] for k, n in most.items())


def _whole(spark, folder):
    """Two hundred documents and some with null, repeated and equal ids, copies, near copies, shared passages and insults; labels of most."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    shared = " ".join(f"passage{i % 37}of{i}" for i in range(60))
    more = [(None, f"{text(700)} {shared}", "en", "a", 0), (None, f"{text(701)} {shared}", "en", "a", 0), (3, text(702), "en", None, 0), (3, text(702), "en", None, 0), (900, "", "en", "a", 0), (900, "", "en", "a", 0), (901, None, None, None, None), (902, text(6), "en", "a", 0), (903, text(6) + " tail", "en", "b", 0), (904, f"é{shared}é", "en", "b", 0)]
    more += [(905 + i, f"You are an idiot, a stupid worthless clown and scum. {text(800 + i, 12)}", "en", "b", 0) for i in range(4)]
    rows = docs + more
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    every = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    known = {r[0] for r in labels}
    rows += [(5000 + r[0], *r[1:]) for r in every if r[0] in known]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_every_stage_on_all_that_the_one_before_kept(spark, tmp_path):
    from tessera.llm.suffix_dedup import brute

    rows = _whole(spark, str(tmp_path))
    docs, kept, handed = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}, {"": rows}
    results, held = {}, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if held is not None:
            assert held.count() == len(handed[before])  # a result stays readable when the next stage has begun
        out.write.parquet(f"{tmp_path}/{name}")
        held, before = out, name
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        handed[name] = [tuple(r) for r in docs.collect()]
        results[name] = docs.columns
        kept[name] = Counter(handed[name])
    assert all(results[name] == corpus_pipeline.COLUMNS for name in ("toxicity", "near_duplicates", "repeats", "mixing"))
    # toxicity: rows are taken away, none changed; the insulting ones go, those without words stay
    assert not kept["toxicity"] - Counter(rows)
    gone = Counter(rows) - kept["toxicity"]
    assert sum("stupid worthless clown" in (r[1] or "") for r in gone.elements()) == 4
    assert all(r[1] for r in gone) and sum(gone.values()) < 0.2 * len(rows)
    # near copies: one of each
    near = kept["near_duplicates"]
    assert not near - kept["toxicity"]
    ids = Counter(r[0] for r in near.elements())
    assert ids[902] == 1 and ids[903] == 0 and ids[900] == 2 and ids[901] == 1 and sum(r[1] == text(702) for r in near.elements()) == 1
    # repeats: as removed by a dictionary of windows over the order that the stage states
    import hashlib

    order = sorted(near.elements(), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = brute([(i, (r[1] or "").encode()) for i, r in enumerate(order)], 100)
    cut = sorted(kept["repeats"].elements(), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(cut) == len(order) and sum(len((r[1] or "").encode()) for r in cut) <= sum(n - gone for n, gone, *_ in want.values())
    whole = {r[0]: r for r in kept["repeats"] if ids[r[0]] == 1}
    for i, r in enumerate(order):
        if ids[r[0]] == 1 and want[i][1] == 0:
            assert r[0] is None or whole[r[0]][:4] == r[:4]
        elif ids[r[0]] == 1 and r[0] is not None and all(c < 128 for c in (r[1] or "").encode()):
            assert hashlib.sha256(whole[r[0]][1].encode()).hexdigest() == want[i][3]
    # mixing: copies of what it was handed, at most two of each
    assert all(n <= 2 * kept["repeats"][r] for r, n in kept["mixing"].items())
    # packing: every word of every row once
    size = lambda t: len((t or "").split())
    packed = Counter()
    for r in handed["packing"]:
        packed[r[0]] += r[3]
    words = Counter()
    for r in handed["mixing"]:
        words[r[0]] += size(r[1])
    assert packed == Counter(words)
    # the whole run is these stages
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(handed["packing"])


def test_an_empty_table_stays_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
