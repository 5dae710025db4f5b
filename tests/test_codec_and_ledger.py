"""Byte codes, Gram matrices, leaking windows and the ledger against plain loops and NumPy."""

import random

import numpy as np
import pytest

from tessera.functions import codec
from tessera.operators import gram, leakage
from tessera.operators import ledger as ledgers
from tessera.plans.registry import QUERIES

WORDS = ["a", "word", "naïve", "漢字漢字", "क्षत्रिय", "😀😀", "x" * 16, "ab" * 20, "é" * 9, "\x7f"]


def constrained(column_scores, room):
    """One word, one byte after another: only bytes after which some valid text can still end in the room."""
    out = b""

    def may(x):
        left = room - len(x)
        for tail in [b"", b"\x80", b"\xa0", b"\x90", b"\x80\x80", b"\xa0\x80", b"\x90\x80", b"\x80\x80\x80", b"\x90\x80\x80"]:
            if len(tail) <= left:
                try:
                    (x + tail).decode()
                    return True
                except UnicodeDecodeError:
                    pass
        return False

    for p in range(room):
        column = column_scores[:, p]
        inside = bool(out) and not may_end(out)
        wish = int(column.argmax())
        need = 3 if 0xF0 <= wish <= 0xF4 else 2 if 0xE0 <= wish <= 0xEF else 1 if 0xC2 <= wish <= 0xDF else 0
        if not inside and out and need >= room - p:
            break
        fit = [b for b in range(256) if may(out + bytes([b]))]
        if not fit:
            break
        out += bytes([max(fit, key=lambda b: column[b])])
    return out


def may_end(x):
    try:
        x.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_codes_without_noise_come_back():
    whole = [w.encode() for w in WORDS]
    codes = codec.encode(whole, 16)
    assert np.allclose(codes.reshape(len(whole), -1).mean(axis=1), 0) and np.allclose(codes.reshape(len(whole), -1).std(axis=1), 1)
    words, margins = codec.decode(codes)
    assert words == [w[:16] for w in whole] and margins.shape == (len(whole), 16)
    held = codec.decode_utf8(codes, np.array([min(len(w), 16) for w in whole]))
    assert held == [w[:16].decode(errors="ignore").encode() for w in whole]
    assert codec.decode(codec.encode([], 4))[0] == []


def test_noise_never_breaks_utf8():
    rng = np.random.default_rng(1)
    scores = rng.standard_normal((200, 256, 6))
    rooms = rng.integers(0, 7, 200)
    got = codec.decode_utf8(scores, rooms)
    assert [g.decode().encode() for g in got] == got
    assert got == [constrained(s, r) for s, r in zip(scores, rooms.tolist(), strict=True)]


def test_gram_recovery_and_ridge_are_numpys(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 12))
    rows = [(v.tolist(),) for v in x] + [(None,), ([1.0] * 11,), ([float("nan")] * 12,), ([float("inf")] * 12,), ([None] * 12,)]
    total, n = gram.gram(spark.createDataFrame(rows, "v array<double>").repartition(5), "v", 12)
    assert n == 300 and np.allclose(total, x.T @ x)
    for k in (1, 5, 12):
        w = gram.projection(k, 12)
        back = x @ w.T @ np.linalg.inv(w @ w.T) @ w
        assert gram.recovery(total, k)["lost"] == pytest.approx(1 - (back**2).sum() / (x**2).sum(), abs=1e-9)
    assert gram.recovery(total, 12)["lost"] == pytest.approx(0, abs=1e-9)
    assert gram.ridge(total, 2.0)["dimensions"] == pytest.approx(np.trace(np.linalg.inv(x.T @ x + 2 * np.eye(12)) @ x.T @ x))
    assert gram.gram(spark.createDataFrame([], "v array<double>"), "v", 12)[1] == 0


@pytest.mark.parametrize("collide", [False, True])
def test_windows_found_as_words_say(spark, monkeypatch, collide):
    if collide:  # every window has one hash: the words alone decide
        monkeypatch.setattr(leakage, "rolled", lambda w, size: np.zeros(max(0, len(w) - size + 1), np.uint64))
    rng = random.Random(3)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 60))] for _ in range(40)] + [["a"] * 30, None, []]
    windows = [["a"] * 4, ["a", "b", "c", "a"], ["z"] * 4, ["b", None, "a", "a"]]
    got = leakage.window_hits(spark.createDataFrame(list(enumerate(windows)), "key long, words array<string>"), spark.createDataFrame(list(enumerate(texts)), "id long, words array<string>").repartition(3), 4).collect()
    for r in got:
        where = [(i, s) for i, t in enumerate(texts) if t for s in range(len(t) - 3) if t[s : s + 4] == windows[r["key"]]]
        assert (r["places"], r["texts"]) == (len(where), len({i for i, _ in where}))
    assert len(got) == 4


def test_rolling_hash_is_one_of_the_window():
    w = np.random.default_rng(4).integers(0, 2**63, 50).astype(np.uint64)
    h = leakage.rolled(np.concatenate([w, w, w[:20]]), 20)
    assert (h[:50] == h[50:100]).all() and len(np.unique(h[:50])) == 50
    assert len(leakage.rolled(w, 51)) == 0


def test_a_crash_between_records_and_version(spark, tmp_path):
    book = ledgers.Ledger(spark, str(tmp_path / "book"), "step long, lane string, tokens long")
    rows = lambda a, b, add=0: spark.createDataFrame([(i, "xy"[i % 2], i + add) for i in range(a, b)], "step long, lane string, tokens long")
    assert book.version() == 0 and book.read().collect() == []
    book.append(rows(0, 10))
    kept = ledgers.checkpoint(book, ["lane"], "tokens", {"plan": "p"})
    assert kept["state"]["next_step"] == 10 and kept["state"]["records"] == 10
    book.append(rows(10, 14, 100))
    book.write(rows(14, 20))  # never committed
    assert book.read().count() == 14
    assert ledgers.restore(book, kept, {"plan": "q"}) == ["plan differs"] and book.read().count() == 14
    bad = {**kept, "state": {**kept["state"], "state_hash": "0"}}
    assert ledgers.restore(book, bad, {"plan": "p"}) == ["the state is not that of the records"]
    assert ledgers.restore(book, kept, {"plan": "p"}) == []
    book.append(rows(10, 20))
    assert sorted(map(tuple, book.read().collect())) == sorted(map(tuple, rows(0, 20).collect()))
    book.rewind(12)
    assert book.read().agg({"step": "max"}).first()[0] == 12 and book.read(2).count() == 14
    with pytest.raises(RuntimeError):
        book._commit([], 1)


def test_articles_run_over_documents(spark, tmp_path):
    long = "many words in a line " * 30
    docs = [(0, f"{long}\nHead.\n{long}", "a"), (1, f"\n{long}\n  \nNext\nshort line", "a"), (2, f"Last\n{long}", "a"), (3, long, None), (4, None, "b")]
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["lane"], r["article"]): (r["first_doc"], r["lines"], r["chars"]) for r in QUERIES["articles"](spark, str(tmp_path)).collect()}
    n = len(long)
    assert got == {("a", 0): (0, 1, n), ("a", 1): (0, 3, 2 * n + 7), ("a", 3): (2, 2, n + 5), (None, 0): (3, 1, n)}


def test_runs_and_clusters_of_planted_words(spark, tmp_path):
    text = "नमस्ते क्षmix é हिन्दी 👩‍👩‍👧 தமிழ் Ω12 漢字かな क्"
    spark.createDataFrame([(1, text, "en", "a", 0), (2, "", "en", "a", 0), (3, "्", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    runs = {r["script"]: (r["runs"], r["chars"], r["clusters"]) for r in QUERIES["script_runs"](spark, str(tmp_path)).collect()}
    # न म स्ते | क्ष | हि न्दी | क् | a lone virama
    assert runs["DEVANAGARI"] == (5, 6 + 3 + 6 + 2 + 1, 3 + 1 + 2 + 1 + 1)
    assert runs["LATIN"] == (2, 4, 4) and runs["GREEK"] == (1, 1, 1) and runs["HAN"] == (1, 2, 2) and runs["HIRAGANA"] == (1, 2, 2)
    assert runs["TAMIL"] == (1, 5, 3)
    assert runs["COMMON"] == (2, 7, 3)  # one family joined to one cluster, two digits
    clusters = {r["doc_id"]: r["clusters"] for r in QUERIES["cluster_counts"](spark, str(tmp_path)).collect()}
    assert clusters[2] == 0 and clusters[3] == 1
