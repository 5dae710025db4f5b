"""Queries against their own SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from tessera.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["text_stats", "normalize_text", "quality_filter", "script_detect", "exact_dedup", "decontaminate_8gram", "safety_drop", "source_manifest", "html_prune", "conversation_spans", "content_split", "band_assign", "pack_concat", "span_clip", "truncation_collisions", "weighted_median_bytes", "noise_floor", "monotonicity_violations", "ledger_contiguity", "resume_equivalence", "selection_decisions", "pricing_summary"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_every_sql_query_has_sql():
    assert set(SQL) <= set(QUERIES)
