"""Cleaning rules on rows worked out by hand, candidates against all pairs, and rows with null ids and sources."""

import hashlib

import duckdb
import pytest

from tessera.plans.registry import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the cat and the dog have been to the market that day"
LONG = "wortlangwortlang wortlangwortlang wortlangwortlang wortlangwortlang wortlangwortlang wortlangwortlang wortlangwortlang wortlangwortlang"


def tables(spark, path, docs, labels=(), benchmark=()):
    spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("one\rtwo three", "one two three"), ("a\x7fb", "a\x7fb"), ("a​b﻿", "ab"), ("a \t　\xa0 b", "a b"), ("a<b>c</b>d", "a c d"), ("x" + "<" + "y" * 41 + ">", "x<" + "y" * 41 + ">"),
        ("\n\n a\n\n\n\nb \n", "a\n\nb"), ("a\x1fb\x00", "ab"), ("क‍क", "क‍क"), ("⁦a⁩", "a"), ("a\r\n\r\n\r\nb", "a \n \n \nb"),
    ],
)
def test_normalized_texts(spark, tmp_path, before, after):
    got = QUERIES["normalize_text"](spark, tables(spark, tmp_path, [(1, before, "en", "a")])).first()
    assert (got["content_hash"], got["chars"], got["changed"]) == (hashlib.sha256(after.encode()).hexdigest(), len(after), before != after)


def test_the_detected_language_picks_the_rules(spark, tmp_path):
    docs = [(1, ENGLISH, "de", "a"), (2, LONG, "de", "a"), (3, LONG + " क", "en", "a"), (4, "1 2 3 4 5 6 7 8", "hi", "a"), (5, "too short", "en", "a")]
    got = {r["doc_id"]: (r["kept"], r["saved_by_language"]) for r in QUERIES["quality_filter"](spark, tables(spark, tmp_path, docs)).collect()}
    # Latin letters are English whatever is claimed, as is a text without letters; one letter of another script makes another language
    assert got == {1: (True, False), 2: (False, False), 3: (True, True), 4: (False, False), 5: (False, False)}


def test_of_equal_scripts_the_first_in_the_text_decides(spark, tmp_path):
    docs = [(1, "ab कக", "en", "a"), (2, "ab கक", "en", "a"), (3, "ககக कक", "en", "a"), (None, "க", "en", "a"), (4, "", "en", "a"), (4, "", "en", "a")]
    got = sorted((r["doc_id"] or 0, r["script"]) for r in QUERIES["language_detect"](spark, tables(spark, tmp_path, docs)).collect())
    assert got == [(0, "Tamil"), (1, "Devanagari"), (2, "Tamil"), (3, "Tamil"), (4, "none"), (4, "none")]


def test_markers_are_whole_words_of_labelled_texts(spark, tmp_path):
    grams = "one two three four five six seven eight nine"
    docs = [(1, "I hate it", "en", "a"), (2, "hateful idiots", "en", "a"), (3, "an IDIOT here", "en", "a"), (4, "idiot!", "en", "a"), (5, "stupid", "en", "a"), (6, f"kill {grams}", "en", "a"), (7, "kill", "en", None)]
    folder = tables(spark, tmp_path, docs, [(1, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 1), (4, 0, 1), (5, 1, 0), (6, 0, 1), (7, 0, 1)], [(0, grams.upper())])
    got = [(r["doc_id"], r["verdict"]) for r in QUERIES["safety_drop"](spark, folder).orderBy("doc_id").collect()]
    assert got == [(1, "toxic"), (2, "kept"), (3, "toxic"), (4, "kept"), (5, "kept"), (6, "contaminated"), (7, "toxic")]


def test_the_funnel_counts_each_document_once(spark, tmp_path):
    grams = "they have been to the market with a big dog"
    docs = [(1, ENGLISH, "en", "a"), (2, ENGLISH, "en", "a"), (3, f"{ENGLISH} hate", "en", "a"), (4, f"{ENGLISH} {grams}", "en", "a"), (5, "short", "en", "a"), (None, f"{ENGLISH} more", "en", None)]
    folder = tables(spark, tmp_path, docs, [(3, 0, 1), (3, 1, 1)], [(0, grams)])
    got = {r["source"]: (r["docs_in"], r["after_quality"], r["after_dedup"], r["docs_out"]) for r in QUERIES["cleaning_funnel"](spark, folder).collect()}
    assert got == {"a": (5, 4, 3, 1), None: (1, 1, 0, 0)}


def test_documents_without_a_source_have_bands(spark, tmp_path):
    docs = [(i, "w " * (i + 1), "en", None if i % 2 else "a") for i in range(20)]
    folder = tables(spark, tmp_path, docs)
    assert sum(r["docs"] for r in QUERIES["band_assign"](spark, folder).collect()) == 20
    assert QUERIES["reserved_docs"](spark, folder).count() == 20


def test_all_candidate_pairs_are_compared(spark):
    """Pairs of documents that share a bucket, from the buckets' members and again from classes and pairs of first documents."""
    sf = "/root/testdata/sf0.01"
    buckets = {}
    for r in QUERIES["lsh_buckets"](spark, sf).collect():
        buckets.setdefault(r["bucket"], []).append(r["doc_id"])
    assert all(len(m) > 1 for m in buckets.values())
    pairs = {(x, y) for m in buckets.values() for x in m for y in m if x < y}
    assert len(pairs) == 135
    first = {r["doc_id"]: r["first_id"] for r in QUERIES["signature_classes"](spark, sf).collect()}
    rows = QUERIES["jaccard_of_candidates"](spark, sf).collect()
    compared = {(r["first_id"], r["second_id"]) for r in rows}
    assert {tuple(sorted((first[x], first[y]))) for x, y in pairs if first[x] != first[y]} == compared
    assert all(r["near"] == (r["jaccard"] >= 0.7) for r in rows if abs(r["jaccard"] - 0.7) > 1e-5)


def test_least_hashes_make_no_row_of_a_shingle(spark, tmp_path):
    """Minima of whole texts by NumPy are those of SQL over shingles, at the edges too; texts are shingled again for pairs alone."""
    long = " ".join(f"w{i * i % 997}" for i in range(1400))
    docs = [(1, long, "en", "a"), (2, long + "".join(f" y{i}" for i in range(50)), "en", "a"), (3, " one\ttwo\v", "en", "a"), (4, " \n", "en", "a"), (5, None, "en", "a"), (6, "é 漢 c d e", "en", "a"), (6, "b é 漢 c d e f", "en", "a"), (7, long, "en", "a")]
    folder = tables(spark, tmp_path, docs)
    for name in ("minhash_signatures", "lsh_buckets", "signature_classes", "jaccard_of_candidates"):
        query = QUERIES[name](spark, folder)
        assert query._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 0
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
        want = con.execute(SQL[name]).fetchall()
        assert sorted(map(tuple, query.collect())) == sorted(want) and want
