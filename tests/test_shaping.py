"""Sources shaped as worked out by hand."""

import hashlib

from tessera.plans.registry import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def documents(spark, path, rows):
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_licences(spark, tmp_path):
    long = "code " * 60
    rows = [(1, f"{long}\nLicensed under the Apache License, Version 2.0.\n"), (2, f"Released under the MIT License.\n{long}"), (3, f"{long}\nGNU General Public License\nMIT License"), (4, "MIT License"), (5, long), (6, f"MIT license, auto-generated {long}"), (7, None), (8, f"a licence of our own {long}"), (9, f"licensed under CC BY-NC 4.0. {long}")]
    got = {r["doc_id"]: (r["licence"], r["verdict"]) for r in QUERIES["licensed_documents"](spark, documents(spark, tmp_path, [(*r, "a") for r in rows])).collect()}
    assert got == {1: ("apache-2.0", "taken"), 2: ("mit", "taken"), 3: ("gpl", "not permissive"), 4: ("mit", "short"), 5: (None, "no licence"), 6: ("mit", "generated"), 7: (None, "no licence"), 8: ("other", "not permissive"), 9: ("cc-by-nc", "not permissive")}


def test_long_texts_in_chunks(spark, tmp_path):
    rows = [(1, "é" * 130001, "a"), (2, "b" * 10000, "a"), (3, "c" * 10001, "a"), (4, None, "a"), (5, "d" * 125000, "a")]
    got = {(r["doc_id"], r["chunk"]): (r["chars"], r["chunk_hash"]) for r in QUERIES["long_chunks"](spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {(1, 0): (60000, sha("é" * 60000)), (1, 1): (60000, sha("é" * 60000)), (1, 2): (10001, sha("é" * 10001)), (3, 0): (10001, sha("c" * 10001)), (5, 0): (60000, sha("d" * 60000)), (5, 1): (60000, sha("d" * 60000))}


def test_answers_and_chats(spark, tmp_path):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "user", " Why? "), (1, 2, "assistant", "So.\n"), (1, 3, "assistant", "More."), (1, 4, "tool", "out"), (2, 0, "user", "Alone"), (3, 0, "user", "a"), (3, 1, "assistant", "x USER: y"), (4, 0, "user", None), (4, 1, "assistant", "z")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spans = {(r["conv_id"], r["turn"], r["role"]): (r["start_char"], r["end_char"], r["loss"], r["span_hash"]) for r in QUERIES["answer_spans"](spark, str(tmp_path)).collect()}
    one, three = "Question: Why?\nAnswer:", "Question: a\nAnswer:"
    assert spans[1, 2, "prompt"] == (0, len(one), 0, sha(one)) and spans[3, 1, "prompt"] == (0, len(three), 0, sha(three))
    assert spans[3, 1, "answer"] == (len(three), len(three) + 10, 1, sha(" x USER: y")) and len(spans) == 4
    chats = [(r["conv_id"], r["span"], r["role"], r["loss"], r["span_hash"]) for r in QUERIES["chat_spans"](spark, str(tmp_path)).orderBy("conv_id", "span").collect()]
    want = [(1, "user", "Why?"), (1, "assistant", "So."), (1, "assistant", "More."), (1, "tool", "out"), (3, "user", "a"), (3, "assistant", "x"), (3, "user", "y"), (4, "assistant", "z")]
    assert [(c, role, loss, h) for c, _, role, loss, h in chats] == [(c, role, int(role == "assistant"), sha(t)) for c, role, t in want]
    assert [s for c, s, *_ in chats] == [1, 2, 3, 4, 1, 2, 3, 1]


def test_an_index_changes_with_any_text(spark, tmp_path):
    rows = [(i, f"text {i}", "a" if i % 3 else None) for i in range(2500)]
    first = {r["source"]: r for r in QUERIES["frozen_index"](spark, documents(spark, tmp_path / "1", rows)).collect()}
    again = {r["source"]: r for r in QUERIES["frozen_index"](spark, documents(spark, tmp_path / "2", rows[::-1])).collect()}
    other = {r["source"]: r for r in QUERIES["frozen_index"](spark, documents(spark, tmp_path / "3", [*rows[:-1], (rows[-1][0], "changed", rows[-1][2])])).collect()}
    assert first == again and first["a"]["content_hash"] != first[None]["content_hash"]
    assert {s for s in first if first[s]["content_hash"] != other[s]["content_hash"]} == {rows[-1][2]}
    assert first["a"]["docs"] == sum(r[2] == "a" for r in rows) and first["a"]["bytes"] == sum(len(r[1]) for r in rows if r[2] == "a")


def test_tags_part_words_of_unlike_blocks(spark, tmp_path):
    # "ab" and its copy two blocks up share low bytes; a long word is cut after 16 characters
    rows = [(1, f"ab {chr(0x261)}{chr(0x262)} {'x' * 16}1 {'x' * 16}2 alone", "a")]
    got = {r["form"]: (r["colliding_groups"], r["colliding_types"], r["occurrences"]) for r in QUERIES["low_digit_keys"](spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {"tagged": (1, 2, 2), "untagged": (2, 4, 4)}
