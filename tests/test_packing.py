"""Shards by token count and next-fit packing against the loops that define them."""

import random
from collections import defaultdict

from tessera.operators import cuts, next_fit
from tessera.plans.registry import QUERIES


def test_shards_close_with_the_crossing_document(spark):
    rng = random.Random(1)
    lanes = {"a": [rng.randint(0, 9) for _ in range(400)], None: [50, 1, 20, 19, 1, 0, 0, 20], "b": [3], "c": [0, 0], "d": [1] * 60}
    rows, want = [], {}
    for lane, sizes in lanes.items():
        off, shard, start, filled = 0, 0, 0, 0
        for i, n in enumerate(sizes):
            rows.append((lane, i, n, off, sum(sizes)))
            if n:
                if filled >= 20:
                    shard, start, filled = shard + 1, off, 0
                filled += n
                want[lane, i] = (shard, off - start)
            off += n
    df = spark.createDataFrame(rows, "lane string, i long, n long, off long, total long").repartition(3)
    shards = cuts.closed_shards(df, ["lane"], 20)
    got = cuts.in_shards(df, shards, ["lane"], 20).collect()
    assert len(got) == len(want) and {(r["lane"], r["i"]): (r["shard"], r["start"]) for r in got} == want
    none = df.where("false")
    assert cuts.closed_shards(none, ["lane"], 20).collect() == []


def loop(docs, length):
    """(seq, start) of the first token of each (n, mode), one after another."""
    seq, taken, out = 0, 0, []
    for n, mode in docs:
        if taken and (mode == next_fit.SEALED or mode == next_fit.WHOLE and taken + n > length):
            seq, taken = seq + 1, 0
        out.append((seq, taken))
        if mode == next_fit.SEALED:
            seq += n
            continue
        taken += n
        while taken >= length:
            seq, taken = seq + 1, taken - length
    return out


def test_tables_composed_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(next_fit, "FAN", 3)
    rng = random.Random(2)
    rows, want = [], {}
    for lane, count in (("a", 300), (None, 7), ("b", 1)):
        docs = []
        for i in range(count):
            mode = rng.choice([next_fit.WHOLE] * 5 + [next_fit.WINDOWS, next_fit.SEALED])
            docs.append((rng.choice([1, 2, 15, 16, rng.randint(1, 16)]) if mode == next_fit.WHOLE else rng.randint(17, 80) if mode == next_fit.WINDOWS else rng.randint(1, 3), mode))
        for i, (d, at) in enumerate(zip(docs, loop(docs, 16), strict=True)):
            rows.append((lane, i // 9 - 5, i, i % 4, *d))  # negative blocks too
            want[lane, i] = at
    df = spark.createDataFrame(rows, "lane string, block long, order long, id long, n long, mode int").repartition(4)
    got = next_fit.placed(df, ["lane"], 16).collect()
    assert len(got) == len(want) and {(r["lane"], r["order"]): (r["seq"], r["start"]) for r in got} == want
    assert next_fit.placed(df.where("false"), ["lane"], 16).collect() == []


def test_atomic_keeps_assistant_turns_whole(spark, tmp_path):
    sizes = {1: [("user", 200), ("assistant", 300)], 2: [("assistant", 13)], 3: [("system", 1300), ("assistant", 400), ("tool", 100), ("assistant", 90), ("user", 600)], 4: [("user", 5), ("assistant", 513)], 5: [("user", 0), (None, 0)], 6: [("user", 512)], 7: [("user", 1)], 8: [("assistant", 510), ("user", 3)]}
    rows = [(c, t, role, "w " * n if n else None) for c, turns in sizes.items() for t, (role, n) in enumerate(turns)] + [(None, 0, "user", "lost")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in QUERIES["pack_atomic"](spark, str(tmp_path)).select("conv_id", "seq", "seq_start", "tok_start", "tok_end", "segment").collect()}
    assert got == {
        (1, 0, 0, 0, 500, 1), (2, 1, 0, 0, 13, 1),
        (3, 2, 0, 0, 512, 1), (3, 3, 0, 512, 1024, 1), (3, 4, 0, 1024, 1300, 1), (3, 5, 0, 1300, 1800, 1), (3, 6, 0, 1800, 1890, 1), (3, 7, 0, 1890, 2402, 1), (3, 8, 0, 2402, 2490, 1),
        (4, None, None, 0, 518, None), (6, 9, 0, 0, 512, 1), (7, 10, 0, 0, 1, 1), (8, 11, 0, 0, 510, 1), (8, 12, 0, 510, 513, 1),
    }


def test_windows_start_in_the_room_that_is_left(spark, tmp_path):
    sizes = [300, 1000, 212, 300, 513]
    rows = [(i, "w " * n, "en", "s", 0) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    train = [i for i in range(len(sizes)) if int(hashlib.sha256(f"split:{i}".encode()).hexdigest()[:8], 16) % 100 >= 8]
    docs = [(sizes[i], next_fit.WINDOWS if sizes[i] > 512 else next_fit.WHOLE) for i in train]
    want = defaultdict(list)
    for i, (n, _), (seq, start) in zip(train, docs, loop(docs, 512), strict=True):
        at = 0
        while at < n:
            took = min(n - at, 512 - start)
            want[seq].append((start, i, at, at + took))
            at, seq, start = at + took, seq + 1, 0
    got = defaultdict(list)
    for r in QUERIES["pack_doc_aligned"](spark, str(tmp_path)).collect():
        got[r["seq"]].append((r["seq_start"], r["doc_id"], r["tok_start"], r["tok_end"]))
        assert r["segment"] == 1 + sum(x < r["seq_start"] for x, *_ in want[r["seq"]])
    assert {k: sorted(v) for k, v in got.items()} == dict(want)
