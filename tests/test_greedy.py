"""Keep-first selection against one pass in order of id."""

import random

from tessera.operators.greedy import keep_first
from tessera.plans.registry import QUERIES


def _pass(rows):
    keys, out, owner = {}, {}, {}
    for i, k in rows:
        keys.setdefault(i, set()).add(k)
    for i in sorted(keys):
        by = [owner[k] for k in keys[i] if k in owner]
        out[i] = min(by) if by else None
        if not by:
            owner.update(dict.fromkeys(keys[i], i))
    return out


def _check(spark, rows):
    got = keep_first(spark.createDataFrame(rows, "id long, key string"))
    found = [(r["id"], r["kept_by"]) for r in got.collect()]
    assert len(found) == len(set(found)) and dict(found) == _pass(rows)


def test_chain_keeps_both_ends(spark):
    _check(spark, [(1, "ab"), (2, "ab"), (2, "bc"), (3, "bc"), (3, "c"), (3, "c")])


def test_hot_bucket_and_random_buckets(spark):
    rng = random.Random(2)
    _check(spark, [(i, "hot") for i in range(300)] + [(1000 + i, str(rng.randrange(60))) for i in range(80) for _ in range(3)])


def test_empty(spark):
    assert keep_first(spark.createDataFrame([], "id long, key string")).collect() == []


def test_documents(spark, tmp_path):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base), " ".join(base), " ".join([*base, "tail"]), "other text of seven plain words here", "", ""]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["verdict"], r["kept_by"]) for r in QUERIES["greedy_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: ("kept", 0), 1: ("exact", 0), 2: ("near", 0), 3: ("kept", 3), 4: ("kept", 4), 5: ("exact", 4)}
