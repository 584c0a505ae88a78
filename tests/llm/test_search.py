import numpy as np
import pytest
from panelloom.llm import mtree


def brute(rows, k, every):
    kept = [(n, i, [int(np.floor(256 * float(x))) for x in v]) for n, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in kept:
        if i is None or i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v)), (1 << 63) if j is None else j) for m, j, v in kept if m != n)
        out += [(i, r + 1, -s) for r, (s, _) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[10][1]) for i in range(n // 3)]  # one vector that many rows share
    return rows + [(50, rows[3][1]), (None, rows[4][1]), (900, None), (950, [1.0, None] + [0.0] * (dim - 2)),
                   (1000, [float("nan")] * dim), (1050, [float("inf")] * dim), (1100, [0.5]), (1150, [])]


@pytest.mark.parametrize("shard, routes, k", [(1024, 1024, 5), (40, 8, 5), (25, 100, 3)])
def test_search_equals_brute_force(spark, shard, routes, k):
    rows = vectors(1, 300, 12)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = mtree.top(df.selectExpr("*", "1 as row", "2 as cell"), k, 50, shard, routes).collect()
    assert sorted((r.query_id, r["rank"], r.score) for r in got) == brute(rows, k, 50)
    assert all(r.vec_id is None or r.vec_id != r.query_id or r.query_id == 50 for r in got)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60, 100)] + [(50, [1.0, 0.0])]
    got = mtree.top(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3, 50, 8, 4).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 60), (2, 61), (3, 62)]


def test_few_large_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top(spark.createDataFrame([], schema)).count() == 0
    assert mtree.top(spark.createDataFrame([(50, [1.0])], schema)).count() == 0
    two = mtree.top(spark.createDataFrame([(50, [3e9]), (51, [-3e9])], schema)).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in two] == [(50, 51, 1 - (1 << 63))]


def test_bounds_skip_distances():
    """On clustered points the search computes few of the distances."""
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(c, 0.5, (200, 8)) for c in rng.normal(0, 40, (5, 8))])
    x = np.floor(points * 256).astype(np.int64)
    space = mtree.Space(8, int(np.abs(x).max()), float((x.astype(float) ** 2).sum(1).max()))
    nodes = mtree.grow(space.lifted(x))
    import pandas as pd

    pages = pd.DataFrame([{"node": i, "parent": n["parent"], "radius": n["radius"], "to_parent": n["to_parent"],
                           "centre": n["centre"].tobytes(), "apart": n["apart"].tobytes(), "points": x[n["entries"]].tobytes(),
                           "rows": n["entries"], "ids": n["entries"]} for i, n in enumerate(nodes)])
    tree, asked = mtree.Tree(pages, space), [0]
    products = space.products
    space.products = lambda a, q: (asked.__setitem__(0, asked[0] + len(a)), products(a, q))[1]
    best = tree.search(x[:1], np.array([0]), 5, np.array([np.inf]), np.array([-mtree.MOST]))[0]
    scores = x.astype(float) @ x[0]
    scores[0] = -np.inf
    assert sorted(-s for s, *_ in best) == sorted(np.sort(scores)[-5:])
    assert asked[0] < len(x) / 2
