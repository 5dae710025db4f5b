"""Rules against rows worked out by hand, not by the text that both engines share."""

import datetime

import pytest

from tessera.plans.registry import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rules"))
    texts = [
        "The cat is in a hat and it sat # on\n\n- one\n- two\n  - one\n- one",
        "• a ● b … c # d",
        "ݐݑ अ",
        "Hi <|im_start|>you [/INST] and [user] there",
    ]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).write.parquet(f"{path}/documents.parquet")
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    steps = [(1, at(0), 7), (2, at(1), 7), (2, at(2), 7), (6, at(3), 7), (4, at(4), 7), (3, at(0), 8)]
    rows = [(i, ts, u, "view", 1.0, "{}") for i, ts, u in steps]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def by_id(spark, name, folder):
    return {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}


def test_quality_metrics(spark, folder):
    out = by_id(spark, "quality_metrics", folder)
    first = out[0]  # lines: the sentence, "- one" twice, "- two", "  - one"
    assert first["n_words"] == 19 and first["stops"] == 6  # 11 words and four lines of two; the in a and it on
    assert first["symbol_ratio"] == round(1 / 19, 6) and first["dup_lines"] == 0.2 and first["bullet_lines"] == 0.8
    assert out[1]["symbol_ratio"] == round(4 / 8, 6) and out[1]["bullet_lines"] == 0.0


def test_arabic_supplement_counts_as_arabic(spark, folder):
    assert by_id(spark, "script_detect", folder)[2]["script"] == "Arabic"


def test_ghost_markers(spark, folder):
    out = by_id(spark, "ghost_markers", folder)
    assert list(out) == [3] and out[3]["markers"] == 3


def test_ledger_contiguity(spark, folder):
    out = {r["branch"]: (r["repeats"], r["gaps"], r["disorder"]) for r in QUERIES["ledger_contiguity"](spark, folder).collect()}
    assert out == {7: (1, 2, 1), 8: (0, 0, 0)}
