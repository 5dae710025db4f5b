"""Toxicity: a gapped-subsequence string-kernel machine with Nystroem landmarks, trained on labelled sentences.

The kernel of two units (words, or single letters written apart and joined again) counts their common subsequences of up
to ORDER letters, each gap weighed down by DECAY, normalised to 1 for equal units: letters put between those of an insult
cost little. Landmarks are words that the labels tell most about, and some plain ones; the kernel matrix of the landmarks
whitens a unit's kernel values into features. A sentence is as toxic as its most toxic unit, a text as its most toxic
sentence, so training alternates between choosing each toxic text's sentence and unit (a latent choice) and fitting a
squared-hinge machine on these against the units of clean sentences. A logistic curve over a text's margin and its
number of units gives the score.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, map_batches, prepare, saved, whole, words

ORDER, DECAY, LONGEST = 3, 0.7, 24
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Letters and digits that a unit must share with a landmark, less than the landmark has; else the kernel counts as 0.
SPARE = 1


def _codes(units: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Units as rows of code points, -1 after the end, and their lengths."""
    size = np.fromiter((min(len(u), longest) for u in units), np.int64, len(units))
    flat = np.frombuffer("".join(u[:longest] for u in units).encode("utf-32-le"), "<u4").astype(np.int32)
    out = np.full((len(units), longest), -1, np.int32)
    out[np.arange(longest) < size[:, None]] = flat
    return out, size


def _raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted common subsequences of rows a[i] and b[i]: one value for each order up to ORDER, by dynamic programming."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    out = np.zeros((n, ORDER), np.float32)
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    equal = (at[:, None] == bt[None]) & (at[:, None] >= 0)
    # ends[i, j]: weight of pairs of subsequences of this order that end at letters i and j; the decay counts letters and gaps
    ends = np.where(equal, d2, np.float32(0))
    out[:, 0] = ends.sum((0, 1))
    for order in range(1, ORDER):
        new = np.zeros_like(ends)
        carry = np.zeros((lb, n), np.float32)  # sums over earlier rows, decayed by distance, and over earlier columns
        for i in range(1, la):
            run = np.zeros(n, np.float32)
            carry *= d
            for j in range(1, lb):
                run *= d
                run += ends[i - 1, j - 1]
                carry[j] += run
            new[i] = equal[i] * (carry * d2)
        ends = new
        out[:, order] = ends.sum((0, 1))
    return out


def _combine(raw: np.ndarray, self_a: np.ndarray, self_b: np.ndarray) -> np.ndarray:
    """The normalised kernel: a weighted mean over the orders; an order that one of both is too short for counts 0."""
    both = np.sqrt(self_a * self_b)
    return np.where(both > 1e-12, raw / np.maximum(both, 1e-12), 0) @ np.array([0.2, 0.3, 0.5], np.float32)


def _masks(codes: np.ndarray) -> np.ndarray:
    bits = np.where(codes >= 0, np.uint64(1) << (codes.astype(np.uint64) % np.uint64(61)), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of each unit and landmark; 0 where too few letters are shared."""
    step = 16384
    return np.concatenate([_kernel(units[i : i + step], landmarks) for i in range(0, max(1, len(units)), step)])


def _kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    ca, _ = _codes(units, LONGEST)
    cb, size = _codes(landmarks, max(map(len, landmarks)))
    ma, mb = _masks(ca), _masks(cb)
    need = np.maximum(1, np.bitwise_count(mb).astype(np.int64) - SPARE)
    shared = np.bitwise_count(ma[:, None] & mb[None, :]) >= need
    out = np.zeros((len(units), len(landmarks)), np.float32)
    own_b = _raw_kernel(cb, cb)
    rows = np.flatnonzero(shared.any(1))
    own_a = np.zeros((len(units), ORDER), np.float32)
    lengths = (ca >= 0).sum(1)
    for wide in (8, 14, LONGEST):  # short units in narrow arrays
        pick = rows[(lengths[rows] <= wide) & ((wide == 8) | (lengths[rows] > (8 if wide == 14 else 14)))]
        for s in range(0, len(pick), 1024):
            some = pick[s : s + 1024]
            own_a[some] = _raw_kernel(ca[some, :wide], ca[some, :wide])
        for j in range(len(landmarks)):
            hit = pick[shared[pick, j]]
            for s in range(0, len(hit), 1024):
                some = hit[s : s + 1024]
                raw = _raw_kernel(ca[some, :wide], np.repeat(cb[j : j + 1, : size[j]], len(some), axis=0))
                out[some, j] = _combine(raw, own_a[some], own_b[j])
    return out


def normal_units(distinct: list[str]) -> list[str]:
    """Lower case, letters and digits only; empty where there are none."""
    return [u if u.isalnum() else "".join(filter(str.isalnum, u)) for u in map(str.lower, distinct)]


def pieces(unit: str) -> list[str]:
    """A unit as it is, or overlapping pieces of one longer than LONGEST."""
    return [unit] if len(unit) <= LONGEST else [unit[i : i + LONGEST] for i in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


SPACED = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")


def joined(text: str) -> list[str]:
    """Units made of single characters written apart."""
    return [re.sub(r"\s+", "", m.group()) for m in SPACED.finditer(text)]


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of kernel values: the whitening times the machine's
    bias: float
    curve: tuple[float, float, float]

    def margins(self, units: list[str]) -> np.ndarray:
        return kernel(units, self.landmarks) @ self.weights + self.bias if units else np.zeros(0)

    def score(self, margin: np.ndarray, count: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * margin + b * np.log1p(count) + c, -40, 40)))


def sentences(text: str) -> list[list[str]]:
    """The distinct units of each sentence; units written apart count in the text's first one."""
    out = []
    for s in SENTENCE.split(text):
        units = normal_units(re.findall(WORD, s))
        out.append(sorted({p for u in units if u for p in pieces(u)}))
    apart = sorted({p for u in joined(text) for p in pieces(u.lower())})
    return [u for u in [*out, apart] if u]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps on the active rows; the last weight is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(40):
        act = y * (z @ w) < 1
        g = weight[act, None] * z[act]
        new = np.linalg.solve(np.diag(ridge) + cost * g.T @ z[act], cost * g.T @ y[act])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _apart(ranked: list[str], most: int, nearest: float = 0.75) -> list[str]:
    """The first ``most`` of ``ranked`` that aren't too like one before them: landmarks that say the same add nothing."""
    like, out = kernel(ranked, ranked), []
    for i in range(len(ranked)):
        if len(out) < most and all(like[i, j] < nearest for j in out):
            out.append(i)
    return [ranked[i] for i in out]


def fit(rows: list[tuple[str, int]], n_toxic: int = 40, n_plain: int = 8, rounds: int = 4, n_clean: int = 10000) -> Model:
    """Fit on (text, label) rows; without both labels, a model that gives every text the share of label 1.

    The rows are a bounded sample. Of their distinct clean units, each round's machine is fitted on the ``n_clean`` of
    highest margin; of the others few would be among its support vectors.
    """
    share = float(np.mean([y for _, y in rows])) if rows else 0.0
    bags = [(sentences(t), y) for t, y in rows]
    seen = {y: Counter(u for b, z in bags if z == y for u in {u for s in b for u in s}) for y in (0, 1)}
    n = {y: max(1, sum(z == y for _, z in bags)) for y in (0, 1)}
    if min(sum(z == y for _, z in bags) for y in (0, 1)) == 0 or not seen[1]:
        at = min(max(share, 1e-6), 1 - 1e-6)
        return Model(["none"], np.zeros(1), 0.0, (0.0, 0.0, float(np.log(at / (1 - at)))))
    told = {u: np.log((c + 0.5) / (n[1] + 1)) - np.log((seen[0][u] + 0.5) / (n[0] + 1)) for u, c in seen[1].items() if len(u) > 3}
    gain = {u: v * np.sqrt(seen[1][u]) for u, v in told.items()}
    toxic = _apart(sorted(gain, key=lambda u: (-gain[u], u))[: 8 * n_toxic], n_toxic)
    plain = [u for u, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if len(u) > 3 and u not in toxic][:n_plain]
    landmarks = toxic + plain
    gram = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > 1e-4
    white = vector[:, keep] / np.sqrt(value[keep])
    units = sorted({u for b, _ in bags for s in b for u in s})
    values = kernel(units, landmarks)
    some = np.flatnonzero(values.any(1))  # units that share too little with every landmark are one unit, the first
    features = np.vstack([np.zeros((1, white.shape[1]), np.float32), values[some] @ white.astype(np.float32)])
    place = np.zeros(len(units), np.int64)
    place[some] = 1 + np.arange(len(some))
    index = dict(zip(units, place.tolist(), strict=True))
    margin, spread = np.zeros(len(features)), np.zeros(len(features))
    for u, i in index.items():
        margin[i] = max(margin[i], told.get(u, 0.0)) if i else 0.0  # the first choice: the unit that the labels tell most about
        spread[i] += seen[0][u]
    del values
    clean = np.flatnonzero(spread > 0)
    w = np.zeros(features.shape[1] + 1)
    for _ in range(rounds):
        chosen = np.array([max((index[u] for s in b for u in s), key=lambda i: (margin[i], -i)) for b, y in bags if y == 1 and b])
        hard = clean[np.argsort(-margin[clean], kind="stable")[:n_clean]]
        x = np.vstack([features[chosen], features[hard]]).astype(np.float64)
        y = np.concatenate([np.ones(len(chosen)), -np.ones(len(hard))])
        weight = np.concatenate([np.ones(len(chosen)), spread[hard]])  # a unit of clean texts counts once for each of them
        w = _machine(x, y, weight)
        margin = features @ w[:-1] + w[-1]
    top = np.array([max((margin[index[u]] for s in b for u in s), default=-9.0) for b, _ in bags])
    count = np.array([len(re.findall(WORD, t)) for t, _ in rows])  # as score_texts counts them
    z = np.stack([top, np.log1p(count), np.ones(len(top))], axis=1)
    y = np.array([y for _, y in bags], float)
    curve, ridge = np.zeros(3), np.array([1e-2, 1.0, 1e-4])
    loss = lambda v: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ v)).sum() + (ridge * v * v).sum() / 2
    for _ in range(60):  # ridge logistic regression by Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9)
        step, t = np.linalg.solve(h, z.T @ (y - p) - ridge * curve), 1.0
        while t > 1e-6 and loss(curve + t * step) > loss(curve):
            t /= 2
        curve = curve + t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return Model(landmarks, (white @ w[:-1]).astype(np.float32), float(w[-1]), tuple(curve))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 2400, longest: int = 6000, held_out: int | None = 5) -> Model:
    """Fit on a bounded sample of labelled rows: at most ``most_rows`` in all, half of each label as far as there are any.

    Rows of texts over ``longest`` characters aren't drawn, nor those whose crc32(id) mod ``held_out`` is 0. The draw is by
    hash of the id, from ids and lengths alone; texts are read for the ids drawn, at most ``most_rows``, which are
    broadcast. One task fits the model; the bound makes its work the same at every size.
    """
    plain = labels.where("toxic in (0, 1)").selectExpr("cast(doc_id as long) as doc_id", "cast(toxic as int) as toxic")
    if held_out:
        plain = plain.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out != 0)
    pool = docs.selectExpr("cast(doc_id as long) as doc_id", "text").where(f"length(text) <= {longest}")
    able = plain.join(pool.select("doc_id"), "doc_id", "left_semi").distinct().withColumn("h", F.xxhash64("doc_id"))
    drawn = saved(reduce(DataFrame.union, [able.where(f"toxic = {y}").orderBy("h", "doc_id").limit(most_rows // 2) for y in (0, 1)]))
    rows = pool.join(F.broadcast(drawn), "doc_id").select("text", "toxic", "h", "doc_id")
    parts = [rows.where(f"toxic = {y}").orderBy("h", "doc_id", "text").limit(most_rows // 2) for y in (0, 1)]  # repeated ids may give more rows

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["toxic"], r["h"], r["doc_id"], r["text"]))
        return pa.table({"model": pa.array([pickle.dumps(fit([(r["text"], r["toxic"]) for r in rows]))], pa.binary())})

    prepare(docs.sparkSession)
    made = reduce(DataFrame.union, parts).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "model binary").first()  # one task, of a bounded sample
    return pickle.loads(made["model"]) if made else fit([])


def score_texts(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` double, from the whole text; null and empty texts are scored as texts without units.

    An old ``score`` column is replaced, others stay.
    """
    base = df.drop("score")
    schema, names = StructType([*base.schema.fields]).add("score", "double"), base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            texts = whole(b.column(names.index(text_col)))
            distinct, index, offsets = words(texts)
            units = normal_units(distinct.to_pylist())
            if len(known) > 400_000:
                known.clear()
            new = sorted({p for u in units for p in pieces(u) if p and p not in known})
            known.update(zip(new, model.margins(new).tolist(), strict=True))
            per_word = np.array([max((known[p] for p in pieces(u) if p), default=-9.0) for u in units])
            top = np.full(len(texts), -9.0)
            some = np.diff(offsets) > 0
            if some.any():
                top[some] = np.maximum.reduceat(per_word[index], offsets[:-1][some])
            apart = pc.match_substring_regex(texts, r"(^|\s)(\S\s+){3,}\S(\s|$)").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(apart).tolist():
                more = [p for u in joined(texts[i].as_py()) for p in pieces(u.lower())]
                top[i] = max(top[i], model.margins(more).max(initial=-9.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(top, np.diff(offsets)))], [*names, "score"])

    return map_batches(base, run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, from labels of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs.select("doc_id", "text"), model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
