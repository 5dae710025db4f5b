"""Windows, languages, schedules and draws against rows worked out by hand or by plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tessera.plans.registry import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _write(spark, path, texts):
    docs = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    return docs


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("windows")), random.Random(3)
    stems = ["".join(rng.choices("abമലയé漢😀", k=n)) for n in range(1, 30)]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "x", "yz", rng.choice(stems)]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return path, _write(spark, path, texts)


def _types(docs):
    out = defaultdict(Counter)
    for _, text, lang, _, _ in docs:
        out[lang].update(text.split())
    return out


def _aligned(b, size):
    if len(b) <= size:
        return b
    front, start = size - size // 2, len(b) - size // 2
    while b[front] & 0xC0 == 0x80:
        front -= 1
    while start < len(b) and b[start] & 0xC0 == 0x80:
        start += 1
    return b[:front] + b[start:]


def test_byte_windows(spark, made):
    path, docs = made
    keys = {"prefix": lambda b, k: b[:k], "both_ends": lambda b, k: b if len(b) <= k else b[: k // 2] + b[-(k // 2) :], "both_ends_aligned": _aligned}
    want = set()
    for lane, types in _types(docs).items():
        for k in (8, 16, 32):
            for name, key in keys.items():
                groups = defaultdict(list)
                for w in types:
                    groups[key(w.encode(), k)].append(w)
                bad = [g for g in groups.values() if len(g) > 1]
                if bad:
                    want.add((lane, name, k, len(bad), sum(map(len, bad)), sum(types[w] for g in bad for w in g)))
    got = {tuple(r) for r in QUERIES["byte_collisions"](spark, path).collect()}
    assert got == want and len(got) > 6


def test_byte_cut_quality(spark, made):
    path, docs = made
    want = set()
    for lane, types in _types(docs).items():
        for k in (16, 32):
            long = [w for w in types if len(w.encode()) > k]
            torn = lost = 0
            for w in long:
                kept = w.encode()[:k].decode(errors="ignore")
                torn += len(kept.encode()) < k
                lost += len(w) - len(kept)
            want.add((lane, k, len(types), len(long), torn, lost))
    assert {tuple(r) for r in QUERIES["byte_cut_quality"](spark, path).collect()} == want


def test_running_sums(spark, made):
    path, docs = made
    off, want = Counter(), {}
    for i, text, _, source, _ in docs:
        h = int(hashlib.sha256(f"split:{i}".encode()).hexdigest()[:8], 16) % 100
        key = (source, "eval" if h < 5 else "holdout" if h < 8 else "train")
        want[i] = off[key]
        off[key] += len(text.split())
    assert {r["doc_id"]: r["off"] for r in QUERIES["shard_offsets"](spark, path).collect()} == want


def test_seeded_prefix(spark, made):
    path, docs = made
    got = {r["doc_id"] for r in QUERIES["seeded_prefix"](spark, path).collect()}
    want = set()
    for s in {d[3] for d in docs}:
        run = 0
        for i, text, *_ in sorted((d for d in docs if d[3] == s), key=lambda d: hashlib.sha256(f"11:{d[0]}".encode()).hexdigest()):
            if run < 4000:
                want.add(i)
            run += len(text.split())
    assert got == want


def test_languages(spark, tmp_path):
    texts = ["plain words", "यह एक वाक्य है", "तो आहे आणि मला", "আমি ভাত খাই", "মই ভাত খাওঁ ৰ", "தமிழ் சொல்", "یہ اردو ہے", "12 34", "hello नमस्ते दोस्त"]
    _write(spark, str(tmp_path), texts)
    got = {r["doc_id"]: r for r in QUERIES["language_detect"](spark, str(tmp_path)).collect()}
    assert [got[i]["lang"] for i in range(9)] == ["en", "hi", "mr", "bn", "as", "ta", "ur", "und", "hi"]
    assert got[8]["code_switched"] and not got[1]["code_switched"] and got[7]["script"] == "none"
    scripts = {r["doc_id"]: r["script"] for r in QUERIES["majority_script"](spark, str(tmp_path)).collect()}
    assert scripts[0] == "LATIN" and scripts[5] == "TAMIL" and scripts[7] == "COMMON"
    gate = {r["doc_id"]: r["admitted"] for r in QUERIES["script_purity_gate"](spark, str(tmp_path)).collect()}
    assert gate[1] and not gate[0] and not gate[7]


def test_tidy_text(spark, tmp_path):
    _write(spark, str(tmp_path), ["a b  \n\n\n\n\n\nc\t\nd\n", "\n a \n"])
    want = ["a b\n\n\nc\nd\n", "a\n"]
    got = {r["doc_id"]: r["tidy_hash"] for r in QUERIES["tidy_text"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(want)}


def test_deficit_schedule(spark):
    shares = {"view": 40, "purchase": 15, "login": 10, "error": 10, "click": 25}
    taken, want = dict.fromkeys(shares, 0), []
    for slot in range(1, 49):
        best = max(shares, key=lambda k: (shares[k] * slot * 512 - 100 * taken[k], k))
        taken[best] += 512
        want.append((slot, best))
    got = sorted((r["slot"], r["lane"]) for r in QUERIES["deficit_schedule"](spark, "/root/testdata/sf0.001").collect())
    assert got == want


def test_slot_draws(spark):
    got = {(r["step"], r["slot"], r["attempt"]): r["draw"] for r in QUERIES["slot_draws"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {(s, k, a): int(hashlib.sha256(f"7:{s}:{k}:{a}".encode()).hexdigest()[:12], 16) % 1000 for s in range(10) for k in range(8) for a in range(4)}
