"""The queries that have SQL against it, on given tables and on one of planted copies, links and empty rows."""

import random

import duckdb
import pytest

from tessera.llm.queries import QUERIES, SQL


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def _both(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", *(("benchmark", "sale_lines") if folder.startswith("/root") else ())):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    ours, theirs = QUERIES[name](spark, folder), con.execute(SQL[name])
    return _rows(ours.columns, ours.collect()), _rows([c[0] for c in theirs.description], theirs.fetchall())


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("planted")), random.Random(5)
    words = ["".join(rng.choices("abcdeé漢", k=rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 3, 4, 5, 40, 200, 900)] + [None, "", passage, passage.upper(), "x" * 350]
    for t in list(texts[5:8]):
        edited = t.split(" ")
        edited[len(edited) // 2] = "other"
        texts += [t, " ".join(edited), t + " " + passage, passage + " end " + t]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    vectors = []
    for label in (0, 1, None):
        for _ in range(12):
            v = [rng.gauss(0, 1) for _ in range(8)]
            vectors += [(label, v), (label, [x + rng.gauss(0, 0.1) for x in v]), (label, [2 * x for x in v])]
    vectors += [(0, None), (0, [0.0] * 8), (0, [float("nan")] + [1.0] * 7), (1, [None] + [1.0] * 7), (1, [float("inf")] * 8)]
    rows = [(i, v, label) for i, (label, v) in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted({*SQL} - {"op12_wand", "op13_bit_slices"}))  # those have tables of their own in their tests
def test_planted(spark, planted, name):
    ours, theirs = _both(spark, planted, name)
    assert ours == theirs and len(ours) > 10


@pytest.mark.parametrize("name", sorted(SQL))
def test_given_tables(spark, name):
    ours, theirs = _both(spark, "/root/testdata/sf0.001", name)
    assert ours == theirs


def test_op2_law(spark, planted):
    docs = QUERIES["op2_rendezvous"](spark, planted).toPandas()
    assert set(docs.law) == {"key"} and docs["shard"].between(0, 39).all() and len(docs) == 25
    assert ((docs.grown_shard == docs["shard"]) | (docs.grown_shard == 40)).all()
    for _, part in docs.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_vectors_of_any_size_link_by_direction(spark, tmp_path):
    """Squares of these components are no doubles, or 0."""
    v = [1e200, 2e200, -3e200]
    vectors = [(0, v), (0, [x * 1e-400 for x in v]), (0, [x / 1e250 / 1e150 for x in v]), (0, [2e-200, 4e-200, -6e-200]), (0, [1.0, 2.0, -3.0]), (0, [0.0, 0.0, 0.0]), (0, [1e308, 0.0, 0.0]), (0, [5e-324, 0.0, 0.0]), (0, [-1e308, 0.0, 0.0]), (1, v)]
    spark.createDataFrame([(i, x, y) for i, (y, x) in enumerate(vectors)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _both(spark, str(tmp_path), "op3_cover_tree")
    assert got == want
    links = {int(r[3]): int(r[2]) for r in got}
    assert links == {0: 3, 1: 0, 2: 3, 3: 3, 4: 3, 5: 0, 6: 1, 7: 1, 8: 0, 9: 0} and sorted(QUERIES["op3_cover_tree"](spark, str(tmp_path)).columns) == ["component_id", "kept", "n_links", "vec_id"]
