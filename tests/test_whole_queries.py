"""Queries that leave no row out: every document decided, whatever its score."""

import duckdb
import pytest

from tessera.plans.registry import QUERIES, SQL
from test_queries import SF, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["selection_decisions", "selection_audit", "effect_table", "strided_sample"])
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_every_document_gets_a_decision(spark, tmp_path):
    texts = ["ab ab cd"] * 40 + ["zz yy"] * 30 + [f"ab cd ef q{i}" for i in range(30)]
    docs = [(None if i == 99 else i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ab cd ef")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = QUERIES["selection_decisions"](spark, str(tmp_path)).collect()
    assert len(out) == 100
    would = {x.doc_id: x.would_be for x in out}
    assert {would[i] for i in range(40)} == {"accept"}  # ranks 30 to 69 are one score, so both thresholds (ranks 34.65 and 59.4) are it
    assert {would[i] for i in range(40, 70)} == {"reject"} and would[None] == "accept"
    audit = QUERIES["selection_audit"](spark, str(tmp_path)).collect()
    assert sum(x.accepts + x.defers + x.rejects + x.overrides for x in audit) == 100


def test_strides_run_over_every_document_of_a_source(spark, tmp_path):
    ids = {"a": [*range(0, 9000, 3), None, None], "b": [5, 7, 2], None: list(range(40000, 40100))}
    docs = [(i, "x", "en", s, 1) for s, of in ids.items() for i in of]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for s, of in ids.items():
        of = sorted(of, key=lambda i: (i is not None, i or 0))
        want += [(s, i, i * 7919 % len(of), of[i * 7919 % len(of)]) for i in range(min(10, len(of)))]
    got = [(x.source, x.i, x.rn, x.doc_id) for x in QUERIES["strided_sample"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
