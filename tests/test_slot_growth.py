"""Slots over many documents: what is sent to the driver, and rows with repeated or missing values."""

import random

import duckdb
import pytest

from tessera.plans import slots
from tessera.plans.dialect import Spark
from tessera.plans.registry import QUERIES, SQL

from test_slots import fill

SF = "/root/testdata/sf0.001"
NAMES = ["batch_accounts", "filled_slots", "slot_gates"]
COUNTS = ("slots", "refused", "held_back", "out_of_band", "relaxed", "empty_slots")


def below_broadcasts(plan):
    """Lines of a plan that stand under an exchange that sends its rows to the driver."""
    depth = None
    for line in plan.split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is not None:
            yield line
        elif "BroadcastExchange" in line:
            depth = at


@pytest.mark.parametrize("name", NAMES)
def test_draws_are_not_broadcast(spark, name):
    """Neither draws, which are a fixed number for each document, nor documents meet each other by way of the driver."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "sha2(" in plan and not [x for x in below_broadcasts(plan) if "sha2(" in x or "place#" in x]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_as_in_sql(spark, tmp_path, name):
    """Repeated and missing ids are one profile each; texts and lanes may be missing, and heads of 512 words end within texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " \n".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30, 200, 700]))), "en", f"src{i % 7}" if i % 7 else None, 0) for i in range(90)]
    rows += [(7, "w1 w2 w2", "en", "src5", 0), (7, "w3\x0bw1", "en", "src6", 0), (1000, "w4 w9 w9", "en", "src3", 0), (1000, "w4 w9 w9", "en", "src3", 0)]
    rows += [(None, "w1 w1 w5", "en", "src2", 0), (None, "w7", "en", "src2", 0), (2000, None, "en", "src1", 0), (2001, " \t", "en", "src9", 0), (2002, "none of it", "en", "src4", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(vocabulary[:10]) + " w1"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", NAMES)
def test_no_documents(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_gates_read_whole_texts(spark, tmp_path):
    """Words that make a document accepted may stand behind its first 512: fewer draws then count, and fewer are refused or out of band."""
    texts = [("x " * 520 + "gold " * 3000) if i % 4 == 0 else ("gold x " * (40 + i)) for i in range(160)]
    spark.createDataFrame([(i, t, "en", f"src{5 + i % 2}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "gold")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tables = {t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark")}
    steps, want, heads = 6, {}, {}
    for gates, first in ((want, None), (heads, slots.HEAD)):
        lanes = {}
        for d in sorted(spark.sql(slots._catalogue(Spark(), first), **tables).collect(), key=lambda d: d["place"]):
            lanes.setdefault(d["lane"], []).append(d)
        order = sorted(lanes)
        for step in range(steps):
            stage = "warm" if step < 0.2 * steps else "main" if step < 0.8 * steps else "anneal"
            for slot in range(slots.SLOTS):
                lane = order[(step + slot) % len(order)]
                chosen, relaxed, counts = fill(lanes[lane], step, slot, stage)
                g = gates.setdefault((stage, lane), dict.fromkeys(COUNTS, 0))
                for k, v in {**counts, "slots": 1, "relaxed": int(relaxed), "empty_slots": int(not chosen)}.items():
                    g[k] += v
    assert want != heads
    assert {(r["stage"], r["lane"]): {k: r[k] for k in COUNTS} for r in QUERIES["slot_gates"](spark, str(tmp_path)).collect()} == want
