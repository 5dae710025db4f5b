"""Slot filling against the loop that defines it, and decisions of selection by hand."""

import hashlib

from tessera.plans import ledgers, slots
from tessera.plans.dialect import Spark
from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
RANGES = {"warm": ("B0", "B2"), "main": ("B1", "B4"), "anneal": ("B2", "B5")}


def fill(lane, step, slot, stage):
    """[(doc_id, filled_from)], relaxed and the gates' counts of one slot."""
    low, high = RANGES[stage]
    pools, best, had, gates = {"accept": [], "defer": []}, None, 0, {"refused": 0, "held_back": 0, "out_of_band": 0}

    def drawn(attempt):
        digest = hashlib.sha256(f"{slots.SEED}:{step}:{slot}:{attempt}".encode()).hexdigest()
        return lane[int(digest[:16], 16) % len(lane)]

    def judge(d):
        nonlocal best
        pool = "accept" if d["decision"] in ("accept", "protected_override") else d["decision"]
        if pool in pools:
            pools[pool].append(d)
        if best is None or d["score"] > best["score"]:
            best = d
        return pool == "accept"

    for attempt in range(slots.ATTEMPTS):
        d = drawn(attempt)
        if d["split"] != "train":
            gates["refused"] += 1
        elif d["reserved"] and stage != "anneal":
            gates["held_back"] += 1
        elif not low <= d["band"] <= high:
            gates["out_of_band"] += 1
        elif judge(d):
            had += d["n"]
            if had >= slots.SEQ:
                break
    relaxed = best is None and gates["held_back"] + gates["out_of_band"] > 0
    if relaxed:
        for attempt in range(slots.ATTEMPTS):
            d = drawn(attempt)
            if d["split"] == "train" and (stage == "anneal" or not d["reserved"]) and judge(d):
                break
    chosen, left = [], slots.SEQ
    for pool in ("accept", "defer"):
        for d in pools[pool]:
            if left > 0:
                chosen.append((d["doc_id"], pool))
                left -= d["n"]
    if not chosen and best is not None:
        chosen = [(best["doc_id"], "exhaustion")]
    return chosen, relaxed, gates


def test_slots_filled_as_by_the_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    catalogue = spark.sql(slots._catalogue(Spark()).replace("{documents}", "{docs}").replace("{benchmark}", "{bench}"), docs=docs, bench=spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    lanes = {}
    for d in sorted(catalogue, key=lambda d: d["place"]):
        lanes.setdefault(d["lane"], []).append(d)
        assert d["place"] == len(lanes[d["lane"]]) - 1
    order = sorted(lanes, key=lambda x: (x is None, x))
    steps = max(6, docs.count() // 100)
    want, gates = {}, {}
    for step in range(steps):
        stage = "warm" if step < 0.2 * steps else "main" if step < 0.8 * steps else "anneal"
        for slot in range(slots.SLOTS):
            lane = order[(step + slot) % len(order)]
            chosen, relaxed, counts = fill(lanes[lane], step, slot, stage)
            for i, (doc, source) in enumerate(chosen):
                want[step, slot, i + 1] = (lane, doc, source, relaxed)
            g = gates.setdefault((stage, lane), {"slots": 0, "refused": 0, "held_back": 0, "out_of_band": 0, "relaxed": 0, "empty_slots": 0})
            for k, v in {**counts, "slots": 1, "relaxed": int(relaxed), "empty_slots": int(not chosen)}.items():
                g[k] += v
    got = QUERIES["filled_slots"](spark, SF).collect()
    assert {(r["step"], r["slot"], r["place"]): (r["lane"], r["doc_id"], r["filled_from"], r["relaxed"]) for r in got} == want and len(got) == len(want)
    assert {"accept", "defer"} <= {x[2] for x in want.values()}
    split = {d["doc_id"]: d["split"] for d in catalogue}
    assert all(split[x[1]] == "train" for x in want.values())
    assert {(r["stage"], r["lane"]): {k: r[k] for k in ("slots", "refused", "held_back", "out_of_band", "relaxed", "empty_slots")} for r in QUERIES["slot_gates"](spark, SF).collect()} == gates


def test_an_override_says_what_it_overrode(spark, tmp_path):
    rows = [(i, text, "en", source, 0) for i, (text, source) in enumerate([("alpha beta", "src0"), ("gamma", "src0"), ("gamma", "src9"), ("alpha", "src9"), ("alpha beta", None)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["would_be"], r["decision"]) for r in QUERIES["selection_decisions"](spark, str(tmp_path)).collect()}
    assert got == {0: ("accept", "accept"), 1: ("reject", "protected_override"), 2: ("reject", "reject"), 3: ("defer", "defer"), 4: ("accept", "accept")}
    assert "src0" in ledgers.PROTECTED
