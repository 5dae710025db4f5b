"""op1, op7 and op9 as registered: rows against rules replayed in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm.packing import best_fit
from tessera.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("contracts")), random.Random(8)
    texts = [" ".join(rng.choices(["ab", "cde", "f", "no break"], k=rng.randint(1, 400))) for _ in range(150)]
    texts += [None, "", " \t\n", "w " * 5000, "w " * 4096] + [texts[0]] * 9
    docs = [(i, t, "en", rng.choice(["a", "b", "B", "ç", "漢", "😀", None]), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, docs


def _size(text):
    return len(WORD.findall(text or ""))


def test_op9_targets_and_copies(spark, folder):
    path, docs = folder
    sizes = defaultdict(int)
    for _, text, _, source, _ in docs:
        sizes[source] += _size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(order, [5, 2, 1] * len(order)))
    left, free, targets = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weights[s] for s in free)
        full = {s for s in free if unit * weights[s] > 2 * sizes[s]}
        for s in full or free:
            targets[s] = 2.0 * sizes[s] if full else unit * weights[s]
        left -= sum(targets[s] for s in full or free)
        free -= full or free
    rows = QUERIES["op9_pivotal"](spark, path).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(docs)))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        _, text, _, source, _ = docs[r["doc_id"]]
        size = _size(text)
        assert r["size"] == size and r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        assert r["taken"] in {0, size, 2 * size}
        taken[source] += r["taken"]
        largest[source] = max(largest[source], size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] + 1e-6 for s in order)
    again = QUERIES["op9_pivotal"](spark, path).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}


def test_op7_covers_every_word_once(spark, folder):
    path, docs = folder
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in QUERIES["op7_best_fit"](spark, path).collect():
        pieces[r["doc_id"]].append((r["start_word"], r["n_words"]))
        bins[r["bin"]].append((r["offset"], r["n_words"], r["doc_id"]))
    for i, text, *_ in docs:
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == _size(text) and pieces[i]
    for held in bins.values():
        at = 0
        for offset, n, _ in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
        assert max(Counter(docs[i][1] for _, _, i in held if docs[i][1]).values(), default=0) <= 1
        assert max(Counter(docs[i][3] for _, _, i in held).values()) <= 2


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(4)
    items = sorted(((rng.randint(0, 60), rng.randrange(4), rng.randrange(40)) for _ in range(400)), key=lambda x: -x[0])
    room, held = {}, defaultdict(list)
    for (size, source, cluster), (_, b, slot, offset) in zip(items, best_fit(items, 100, 2), strict=True):
        fits = [r for k, r in room.items() if r > 0 and r >= size and all(c != cluster for _, c in held[k]) and sum(s == source for s, _ in held[k]) < 2]
        assert (b in room) == bool(fits)
        if fits:
            assert room[b] == min(fits)
        room.setdefault(b, 100)
        assert slot == len(held[b]) and offset == 100 - room[b]
        room[b] -= size
        held[b].append((source, cluster))


#: The insults of the given tables in plain letters; of their texts labelled toxic a part holds none.
INSULTS = ["trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "loser", "scum", "moron"]


def test_op1_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has six held-out toxic texts
    known = {i: (text, toxic) for i, text, toxic in duckdb.execute(f"select d.doc_id, text, toxic from '{sf}/documents.parquet' d join '{sf}/labels.parquet' l on l.doc_id = d.doc_id").fetchall()}
    rows = QUERIES["op1_toxicity"](spark, sf).collect()
    assert len(rows) == 10000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], *known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    insulting = [p for p, text, toxic in held if toxic and any(w in text.lower() for w in INSULTS)]
    clean = [p for p, text, toxic in held if not toxic]
    assert len(insulting) >= 50 and sum(insulting) >= 0.95 * len(insulting)
    assert sum(clean) <= 0.05 * len(clean)
