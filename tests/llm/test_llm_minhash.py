"""MinHash near-dedup against all-pairs comparison on full sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from llm_fixtures import SMALL, no_docs, odd_docs  # noqa: F401
from ledgerlens.llm import catalog, components, minhash


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = catalog.op1_minhash_near_dedup(spark, SMALL).collect()
    want = brute.components(texts, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert any(i != c for i, (_, c) in want.items())


def test_chunked_groups_lose_no_link(spark):
    """One large near-copy group, with lists and components cut into many chunks."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 3)):
            w[j] = f"z{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"q{rng.integers(0, 10 ** 6)}" for _ in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(dict(rows), 4)
    assert as_dict(minhash.near_duplicates(docs, 4, list_chunk=16, set_chunk=1500)) == want
    assert as_dict(minhash.near_duplicates(docs, 4)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, 5).collect()
    assert len(rows) == odd_docs.count()
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert got[(2, 56)] == (1, False) and got[(1, 56)] == (1, True)
    assert got[(3, 0)] == (3, True) and got[(4, 0)] == (4, True) and got[(None, 0)] == (None, True)
    assert got[(6, 1)] == (6, True) and got[(7, 1)] == (6, False)  # A-Z count as a-z
    assert got[(None, 57)] == (1, False)
    assert minhash.near_duplicates(no_docs, 5).count() == 0
    kept = minhash.drop_near_duplicates(odd_docs, 5)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(
        [(False, i) for i in (1, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14)] + [(True, 0)])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 ** 63, 4000).astype(np.uint64)
    got = []
    for k in range(20):
        b = np.concatenate([a[:3600], rng.integers(0, 2 ** 63, 400).astype(np.uint64)])
        got.append((minhash.signature(a) == minhash.signature(b)).mean())
        a = rng.integers(0, 2 ** 63, 4000).astype(np.uint64)
    assert abs(np.mean(got) - 3600 / 4400) < 0.03


def test_threshold_is_that_of_the_exact_tail():
    from math import comb
    for percent in (50, 80, 95):
        s, least = percent / 100, minhash.match_threshold(percent)
        below = lambda t: sum(comb(64, k) * s ** k * (1 - s) ** (64 - k) for k in range(t))
        assert below(least) <= 1 / minhash.MISSES < below(least + 1)
    assert minhash.match_threshold(80) == 32


def test_small_sets_lose_no_link(spark):
    """Thousands of short texts of which signatures say little."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        w = [f"v{i % 250}x{k}" for k in range(int(rng.integers(3, 28)))]
        w = w[:int(rng.choice([len(w), max(1, len(w) - 1), max(1, len(w) - 2)]))]
        rows.append((i, " ".join(w)))
    want = brute.components(dict(rows), 4)
    assert as_dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)) == want


def test_rows_without_ids_are_told_apart_by_their_text(spark):
    rows = [(None, f"{' '.join(f'a{i}w{k}' for k in range(30))} end{j}") for i in range(60) for j in range(3)]
    labels = minhash.labelled(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert labels.select("label").distinct().count() == 60


@pytest.mark.parametrize("edges", [[], [(2, 1)], [(i, i + 1) for i in range(40)], [(i, 0) for i in range(1, 30)],
                                   [(1, 2), (2, 3), (10, 11), (11, 12), (12, 3), (20, 21)]])
def test_connected_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected(df).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        merged = want[a] | want[b]
        for x in merged:
            want[x] = merged
    assert got == {x: min(s) for x, s in want.items()}


def test_groups_of_the_same_members_give_the_same_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(n), 1) for g in range(30) for n in rng.permutation(200)]
    members = spark.createDataFrame(rows, "g long, node long, weight int").repartition(7)
    edges = components.link(members, lambda df: df.withColumn("payload", F.lit(bytes(2 * minhash.K))),
                            minhash.SignatureLinker(minhash.K), 10_000)
    assert sorted(map(tuple, edges.collect())) == [(0, n) for n in range(1, 200)]
