import numpy as np
import pytest

from boardfoot.llm.components import components
from boardfoot.llm.nearest import nearest
from boardfoot.llm.range_join import near_vectors, unit


def vectors(n, seed):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 16))
    for i in range(n // 2):
        v[i] = v[n - 1 - i] + r.normal(size=16) * r.choice([0, 0.05, 0.12])
    v[:40] = v[0]
    return v


BAD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [1.0] * 16, None), (None, [1.0] * 16, 1)]


@pytest.mark.parametrize("cell, block", [(16_384, 4096), (60, 25)])
def test_range_join_equals_brute_force(spark, cell, block):
    v = vectors(400, 1)
    rows = [(i, list(map(float, x)), i % 3) for i, x in enumerate(v)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows + BAD, "vec_id long, embedding array<double>, label int"), cell_size=cell, block=block).collect()}
    u, label = unit(v), np.arange(400) % 3
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    low = np.arange(400)
    for _ in range(400):
        low = np.minimum(low, np.where(near, low, 400).min(axis=1))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(400)] == list(zip(near.sum(1).tolist(), low.tolist()))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9001, 9006))
    assert got[None]["component_id"] is None and not got[None]["kept"]


def test_nearest_recall_and_scores(spark):
    v = vectors(1500, 2)
    rows = [(i, list(map(float, x)), 1) for i, x in enumerate(v)]
    got = nearest(spark.createDataFrame(rows + BAD[:4] + BAD[5:], "vec_id long, embedding array<double>, label int")).collect()
    u = unit(v)
    hits = 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        score = np.round(u @ u[q], 12)
        score[q] = -9
        best = np.lexsort((np.arange(1500), -score))[:5]
        hits += len(set(best) & {r["vec_id"] for r in mine})
        for r in mine:
            assert r["score"] == pytest.approx(u[r["vec_id"]] @ u[q], abs=1e-12)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
    assert hits >= 0.9 * 150


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert nearest(spark.createDataFrame([], schema)).count() == 0
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = nearest(spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)], schema)).collect()
    assert [(r["query_id"], r["vec_id"]) for r in rows] == [(0, 1)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 2), (5, 5), (9, 8), (8, 7), (100, 7), *[(50, i) for i in range(51, 90)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 1 for i in (1, 2, 3)}, **{i: 7 for i in (7, 8, 9, 100)}, **{i: 50 for i in range(50, 90)}}


@pytest.mark.parametrize("near, n", [(1000, 3000), (2000, 2500)])
def test_nearest_in_a_dense_group(spark, near, n):
    """Codes cannot tell the members of a group around one centre apart; each is scored all the same. Copies go by the smaller id."""
    rng = np.random.default_rng(near)
    x = rng.normal(size=(n, 64))
    x[:near] = x[0] / np.linalg.norm(x[0]) + 0.05 * rng.normal(size=(near, 64))
    x[n - 200 : n] = x[n - 1]
    x = x[rng.permutation(n)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=1000).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    shares = []
    for q, found in got.items():
        score = np.round(u @ u[q], 12)
        score[q] = -2
        want = np.lexsort((np.arange(n), -score))[:5]
        shares.append(len(set(want.tolist()) & set(found.values())) / 5)
    assert len(got) == n // 50 and min(shares) >= 0.8 and np.mean(shares) >= 0.99


def test_a_task_holds_one_block_at_a_time(spark, monkeypatch):
    """Blocks keep their size though a batch holds more rows, and pairs of blocks go to Python one by one."""
    from boardfoot.llm import nearest as module

    kept, rows = {}, []

    def write(df, name, to=module.materialize):
        rows.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        kept[name] = to(df, name)
        return kept[name]

    monkeypatch.setattr(module, "materialize", write)
    v = vectors(1000, 5)
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest(df, every=10, block=300, lot=30).collect()}
    assert [len(r["ids"]) // 8 for r in kept["codes"].collect()] == [300, 300, 300, 100]
    assert max(len(r["queries"]) // 8 for r in kept["queries"].collect()) == 30
    assert rows[list(kept).index("near")] == "1"
    u = unit(v)
    hits = [got[q, 1] == np.lexsort((np.arange(1000), -np.where(np.arange(1000) == q, -9, np.round(u @ u[q], 12))))[0] for q in range(0, 1000, 10)]
    assert np.mean(hits) > 0.95
