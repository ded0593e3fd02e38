"""Vector searches against brute force."""

import numpy as np
import pytest

from wattline.llm.ann import search_multi_index, traverse
from wattline.llm.exactknn import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:230] = x[100]  # one vector with many copies
    rows = [(i, [float(c) for c in v], 0, 0.0) for i, v in enumerate(x)]
    bad = [(400, None, 0, 0.0), (450, [float("nan")] * 8, 0, 0.0), (500, [None] + [1.0] * 7, 0, 0.0), (550, [float("inf")] * 8, 0, 0.0), (600, [1.0], 0, 0.0), (None, [1.0] * 8, 0, 0.0)]
    return x, spark.createDataFrame(rows + bad + rows[:1], SCHEMA)


def best(scores, ids, query, k):
    return [(int(i), float(s)) for s, i in sorted((-s, i) for s, i in zip(scores, ids) if i != query)[:k] for s in [-s]]


def test_exact_top_k(spark, table):
    x, df = table
    whole = np.floor(256.0 * x.astype(np.float64))
    out = exact_top_k(df, pivots=6, pack=3, step=16).collect()
    assert {r["query_id"] for r in out} == set(range(0, 400, 50))
    for q in range(0, 400, 50):
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["vec_id"], float(r["score"])) for r in mine] == best(whole @ whole[q], range(400), q, 5)


def test_multi_index_recall_and_scores(spark, table):
    x, df = table
    x = x.astype(np.float64)
    out = search_multi_index(df, centroids=8).collect()
    hits = 0
    for q in range(0, 400, 20):
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 20 and len({r["vec_id"] for r in mine}) == 20
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert np.allclose([r["score"] for r in mine], [x[r["vec_id"]] @ x[q] for r in mine], rtol=1e-12)
        hits += len({r["vec_id"] for r in mine} & {i for i, _ in best(x @ x[q], range(400), q, 20)})
    assert hits / (20 * 20) >= 0.9


def test_traverse_visits_pairs_in_order():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=7), rng.normal(size=9)
    found = traverse(a, b, np.ones((7, 9), int), 63)
    assert len(set(found)) == 63
    assert [a[i] + b[j] for i, j in found] == sorted(a[i] + b[j] for i, j in found)


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, 0.0), (1, [1.0, 1.0], 0, 0.0), (2, [0.0, 0.0], 0, 0.0)], SCHEMA)
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in exact_top_k(few).orderBy("rank").collect()] == [(0, 1, 196608), (0, 2, 0)]
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in search_multi_index(few).collect()] == [(0, 1, 3.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert exact_top_k(none).count() == 0 and search_multi_index(none).count() == 0


@pytest.mark.parametrize("shape", ["spread", "clustered"])
def test_recall_of_the_registered_settings(spark, shape):
    """The index is at work at every size: half of the rows are left out of the reranking, and 0.9 of the nearest are found."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    if shape == "clustered":
        x = 0.3 * x + rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    out = search_multi_index(df, k=20, every=20).collect()
    assert len(out) == 150 * 20
    found: dict[int, set[int]] = {}
    for r in out:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    y = x.astype(np.float64)
    recall = np.mean([len(found[q] & {i for i, _ in best(y @ y[q], range(3000), q, 20)}) / 20 for q in found])
    assert 0.9 <= recall


def test_one_id_with_many_high_vectors(spark):
    rows = [(7, [float(100 + k)]) for k in range(30)] + [(i, [float(i)]) for i in (0, 20, 40, 50, 60, 100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in exact_top_k(df, k=3).where("query_id = 50").orderBy("rank").collect()]
    assert got == [(7, 256 * 129 * 256 * 50), (100, 256 * 100 * 256 * 50), (60, 256 * 60 * 256 * 50)]
    got = [r["vec_id"] for r in search_multi_index(df, k=3, share=1.0).where("query_id = 40").orderBy("rank").collect()]
    assert got == [7, 100, 60]


def test_large_components(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0]), (3, [-(2.0**40), 0.0]), (4, [2.0**50, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    want = sorted(((-min(max(sum(a * b for a, b in zip(whole[0], whole[i])), -(2**63)), 2**63 - 1), i) for i in range(1, 5)))
    assert [(-r["score"], r["vec_id"]) for r in exact_top_k(df).orderBy("rank").collect()] == want
