"""op13: places and ties against a sort of each group, with groups dealt out in pieces."""

import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import bit_slices
from tessera.llm.bit_slices import first_places
from tessera.llm.queries import QUERIES

SCHEMA = "g string, h long, a long, b int, t string, u long, pos_ int, n int, lines string"


def brute(rows, places):
    """(g, h, pos, tied, a, b, t, u): a from large to small, b, t, u from small to large, nulls last."""
    groups = defaultdict(list)
    for g, h, a, b, t, u, *_ in rows:
        groups[g, h].append((a, b, t, u))
    out = []
    for (g, h), lines in groups.items():
        lines.sort(key=lambda x: (x[0] is None, -(x[0] or 0), *[y for v, least in zip(x[1:], (0, "", 0), strict=True) for y in (v is None, least if v is None else v)]))
        for i, x in enumerate(lines[:places]):
            out.append((g, h, i + 1, sum(y[:2] == x[:2] for y in lines), *x))
    return sorted(out, key=str)


def rows(n, seed=1, far=False):
    rng = random.Random(seed)
    near = [None, 0, 1, 2, 3, -1, -7]
    edge = [*near, 2**63 - 1, -(2**63), 2**40]
    some = lambda: (rng.choice(["x"] * 12 + ["y", "z", None]), rng.choice([None, -1, 4]), rng.choice(edge if far else near), rng.choice([None, 0, 5, -3]), rng.choice([None, "", "k", "l"]), rng.choice([None, 8, 9]), 1, 2, "w")
    return [some() for _ in range(n)]


def got(df, places):
    out = first_places(df, ["g", "h"], [("a", True), ("b", False)], ["t", "u"], places)
    assert out.columns == ["g", "h", "pos", "tied", "a", "b", "t", "u"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize(("piece", "places", "far"), [(4096, 2, False), (4096, 100, True), (70, 5, False), (1, 1, False)])
def test_places_and_ties(spark, monkeypatch, piece, places, far):
    monkeypatch.setattr(bit_slices, "PIECE", piece)
    lines = rows(900, far=far)
    assert got(spark.createDataFrame(lines, SCHEMA).repartition(5), places) == brute(lines, places)


def test_one_value_and_equal_lines(spark, monkeypatch):
    monkeypatch.setattr(bit_slices, "PIECE", 8)
    lines = [("x", 1, 5, 5, "t", 1, 1, 1, "")] * 100 + [("y", None, None, None, None, None, 1, 1, "")] * 3
    assert got(spark.createDataFrame(lines, SCHEMA), 3) == brute(lines, 3)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA), 2) == []


def test_bits_order_like_values(spark):
    values = [2**63 - 1, -(2**63), 0, -1, 1, 2**40, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for larger in (True, False):
        longs, places = bit_slices._packed(bit_slices._bits(df, [("v", larger)]))
        assert len(places) == 65 and len(longs) == 2
        coded = df.select("v", *[c.alias(f"c{i}") for i, c in enumerate(longs)]).collect()
        assert [r["v"] for r in sorted(coded, key=lambda r: (r["c0"], r["c1"]))] == sorted(values, key=lambda v: (v is None, (-v if larger else v) if v is not None else 0))


def test_registered(spark, tmp_path, monkeypatch):
    """Lines of a fifth of the sales form one group, which is dealt out; broken discounts and repeated lines are kept."""
    from datetime import datetime

    monkeypatch.setattr(bit_slices, "PIECE", 32)
    rng = random.Random(5)
    day = lambda: rng.choice([None, datetime(2024, rng.randint(1, 5), 3), datetime(1999, 12, 31)])
    lines = [(rng.choice([None, *range(60)]), rng.randint(1, 3), rng.choice([None, 7, 8, -8]), rng.choice([None, 1, 2]), rng.choice([None, 5, 15, 25, 27]), rng.choice([None, 1.005, 2.0]), rng.choice([0.01, 0.02, float("nan"), None]), "f", day()) for _ in range(1500)]
    spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz").write.parquet(f"{tmp_path}/sale_lines.parquet")
    groups = defaultdict(list)
    cents = lambda x: None if x is None or x != x else int((100 * x + 0.5) // 1)
    for s, no, item, vendor, quantity, amount, discount, _, at in lines:
        part = -1 if item is None else abs(item) % 5 * (1 if item > 0 else -1)
        key = (-1, -1, -1) if s is not None and zlib.crc32(str(s).encode()) % 5 == 0 else (vendor, part, -1 if at is None else 100 * at.year + at.month)
        groups[key].append((None if quantity is None else quantity // 10, cents(discount), s, no, quantity, cents(amount)))
    want = []
    for key, held in groups.items():
        held.sort(key=lambda x: (x[0] is None, -(x[0] or 0), *[y for v in x[1:] for y in (v is None, v or 0)]))
        want += [(*key, i + 1, i + 1, *x[2:5], x[1], x[5], sum(y[:2] == x[:2] for y in held)) for i, x in enumerate(held[:2])]
    out = QUERIES["op13_bit_slices"](spark, str(tmp_path))
    assert out.columns == ["vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
