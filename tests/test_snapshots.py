"""Rotating snapshots replayed with NumPy over the smallest documents."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np

from tessera.plans import snapshots
from tessera.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def unit(counts):
    norm = math.sqrt(sum(v * v for v in counts.values()))
    return {w: v / norm for w, v in counts.items()} if norm else {}


def test_decisions_of_every_generation(spark):
    docs = [(r["doc_id"], r["source"], [w for w in (r["text"] or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    lanes = defaultdict(list)
    for d in sorted((d for d in docs if d[2]), key=lambda d: d[0]):
        lanes[d[1]].append(d)
    order = sorted(lanes, key=lambda x: (x is None, x or ""))
    share = {lane: snapshots.SHARES[i % 3] for i, lane in enumerate(order)}
    stride = lambda lane, n: [lanes[lane][i * 7919 % len(lanes[lane])] for i in range(min(n, len(lanes[lane])))]
    free = [lane for lane in order if lane not in ("src0", "src1")]
    total = sum(share[x] for x in free)
    sample = [d for lane in free for d in stride(lane, max(4, math.floor(snapshots.CALIBRATION_DOCS * len(free) * share[lane] / total + 0.5)))]
    profiles = {d[0]: unit(Counter(d[2][:512])) for d in docs}
    decided, cuts = {}, {}
    for g in range(snapshots.GENERATIONS):
        golden = Counter()
        for i, lane in enumerate(sorted(snapshots.REFERENCE)):
            for w, v in unit(Counter(w for d in stride(lane, snapshots.REFERENCE_DOCS) for w in d[2])).items():
                golden[w] += v * (0.5 if i == g % 3 else 1.0)
        golden = unit(golden)
        score = {i: sum(v * golden.get(w, 0.0) for w, v in p.items()) for i, p in profiles.items()}
        of_sample = [score[d[0]] for d in sample]
        cuts[g] = accept, reject = np.quantile(of_sample, 0.5), np.quantile(of_sample, 0.25)
        for i, lane, words in docs:
            if words:
                would = "accept" if score[i] >= accept - 1e-9 else "defer" if score[i] >= reject - 1e-9 else "reject"
                decided[g, i] = (would, "protected_override" if lane in ("src0", "src1") and would != "accept" else would)
    got = {(r["generation"], r["doc_id"]): (r["would_be"], r["decision"]) for r in QUERIES["rotating_decisions"](spark, SF).collect()}
    assert got == decided
    assert len({tuple(v for (g, _), v in sorted(got.items()) if g == k) for k in range(3)}) == 3  # a rotation changes decisions
    for r in QUERIES["snapshot_thresholds"](spark, SF).collect():
        assert abs(r["accept_at"] - cuts[r["generation"]][0]) < 2e-6 and abs(r["reject_at"] - cuts[r["generation"]][1]) < 2e-6


def test_a_step_is_written_once_and_repeated_ids_are_one_profile(spark, tmp_path, monkeypatch):
    from tessera.operators.written import Steps

    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(5 + i % 700)), f"src{i % 6}") for i in range(400)]
    rows += [(None, "w1 w2", "src2"), (7, "w1 w1 w9", "src4"), (500, " \t\n", "src3"), (501, None, "src3"), (502, "  w5", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made, keep = [], Steps.keep
    monkeypatch.setattr(Steps, "keep", lambda self, df: made.append(df.columns) or keep(self, df))
    for name in snapshots.QUERIES:
        made.clear()
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
        assert [c for columns in made for c in columns].count("accept_at") == 1 and not any("text" in columns for columns in made)
        with duckdb.connect() as db:
            db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
            assert got == sorted(db.execute(SQL[name]).fetchall(), key=repr)
