"""Nearest neighbours against a full product in double precision."""

import numpy as np
from pyspark.sql import functions as F

from llm_fixtures import SMALL
from ledgerlens.llm import catalog, nearest


def want(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]], q
        assert np.allclose([s for _, s in a[q]], [s for _, s in b[q]], rtol=1e-12, atol=1e-12)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    same(got(catalog.op3_nearest_neighbours(spark, SMALL)), want(vectors, [i for i in vectors if i % 20 == 0], 20))


def test_small_blocks_scales_and_ties(spark):
    rng = np.random.default_rng(4)
    vectors = {i: np.round(rng.normal(size=6) * 10.0 ** rng.integers(-2, 3), 3) for i in range(300)}
    for i in range(100, 160):
        vectors[i] = vectors[100]  # equal vectors tie; the smaller id comes first
    vectors = {i: np.where(v.any(), v, 1.0) for i, v in vectors.items()}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    found = got(nearest.search(df.repartition(5), F.col("vec_id") % 7 == 0, 15, query_block=8, candidate_block=16))
    exact = {q: [(i, float(np.einsum("j,j->", vectors[q], vectors[i]))) for i, _ in r] for q, r in found.items()}
    same(found, exact)
    same(found, want(vectors, [i for i in vectors if i % 7 == 0], 15))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame([(a, b, "n", 1) for a, b in rows], "vec_id long, embedding array<double>, n string, dim int")
    out = nearest.search(df, F.col("vec_id").isin(0, 2, 4, 5, 8), 5)
    assert got(out) == {0: [(1, 0.5), (1, 0.5), (9, -1.0)]}
    assert nearest.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 32)) * 5, rng.normal(size=(50, 32)) ** 3
    (qa, sa, la, na), (qb, sb, lb, nb) = nearest.quantise(a), nearest.quantise(b)
    near = nearest.integer_products(qa, qb) * sa[:, None] * sb
    error = la[:, None] * nb + (na + la)[:, None] * lb
    assert (np.abs(a @ b.T - near) <= error).all() and np.abs(near - a @ b.T).max() > 0
    wide = rng.integers(-127, 128, (2, 3000)).astype(np.int8)
    assert nearest.integer_products(wide, wide)[0, 1] == np.dot(wide[0].astype(int), wide[1].astype(int))


def test_extreme_components_take_part(spark):
    """Finite vectors far from 1 are candidates and queries like any other."""
    big, tiny = 1e200, 1e-200
    vectors = {0: [1.0, 2.0], 1: [tiny, tiny], 2: [big, 0.0], 3: [-big, tiny], 4: [5e-324, 0.0], 5: [1e308, 1e308],
               6: [3.0, -1.0], 7: [1e-60, 1.0], 8: [-1e308, 1e308], 9: [1e308, -1e308]}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    found = got(nearest.search(df, F.lit(True), 4, query_block=3, candidate_block=3))
    for q, rows in found.items():
        with np.errstate(all="ignore"):
            scored = [(float(vectors[q][0] * v[0] + vectors[q][1] * v[1]), i) for i, v in vectors.items() if i != q]
        want_ids = [i for s, i in sorted(scored, key=lambda x: (np.isnan(x[0]), -x[0] if x[0] == x[0] else 0, x[1]))][:4]
        assert [i for i, _ in rows] == want_ids, q
    assert len(found) == len(vectors)


def test_single_precision_and_lanes(spark, monkeypatch):
    """Single-precision vectors travel as they are; many lanes and small blocks change nothing."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    packed = nearest.pack(df, 64).collect()
    assert sum(r["n"] for r in packed) == 400 and all(len(r["vectors"]) == 4 * 24 * r["n"] for r in packed)
    vectors = {i: v.astype(float) for i, v in enumerate(x)}
    want_rows = want(vectors, [i for i in vectors if i % 9 == 0], 10)
    for lane_blocks in (1, 100):
        monkeypatch.setattr(nearest, "LANE_BLOCKS", lane_blocks)
        same(got(nearest.search(df.repartition(6), F.col("vec_id") % 9 == 0, 10, 16, 32)), want_rows)
