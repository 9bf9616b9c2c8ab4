"""Mixing: targets by resharing, exact quotas, the law of the split, and reruns."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from ledgerlens.llm import catalog, mixing
from llm_fixtures import SMALL, no_docs, odd_docs  # noqa: F401

U = "(pmod(xxhash64(id), 9007199254740992) + 0.5D) / 9007199254740992D"


def test_query_reaches_targets(spark):
    rows = catalog.op4_mix_sources(spark, SMALL).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    sizes, taken, target, biggest = Counter(), Counter(), {}, 256
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(brute.words(d["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = r["target"]
    want = brute.targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9) and abs(taken[s] - target[s]) <= biggest / 2
    assert all(r["source_size"] == sizes[docs[r["doc_id"]]["source"]] for r in rows)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 50, None: 7}, {"a": 5, "b": 0, "c": 10_000},
                                   {"z": 10, "é": 10, "Z": 10}, {"a": 0}, {f"s{i:02}": 3 ** (i % 9) for i in range(40)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows, (5, 2, 1), 3, F.lit(1)).collect()}
    want = brute.targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert got == pytest.approx(want)


def test_hypergeometric_law(spark):
    from math import comb
    p = spark.range(20_000).select(
        F.expr(mixing.hypergeometric_sql("50", "20", "15", U)).alias("x"),
        F.expr(mixing.hypergeometric_sql("3000000", "1000000", "700000", U)).alias("y"),
        F.expr(mixing.hypergeometric_sql("10", "10", "4", U)).alias("all"),
        F.expr(mixing.hypergeometric_sql("10", "0", "4", U)).alias("none"),
        F.expr(mixing.hypergeometric_sql("0", "0", "0", U)).alias("zero")).toPandas()
    for k in range(16):
        assert abs((p.x == k).mean() - comb(20, k) * comb(30, 15 - k) / comb(50, 15)) < 0.015
    share, sd = 1 / 3, np.sqrt(700_000 * (1 / 3) * (2 / 3) * (2_300_000 / 2_999_999))
    assert abs(p.y.mean() - 700_000 * share) < 5 * sd / np.sqrt(20_000) and abs(p.y.std() / sd - 1) < 0.03
    assert set(p["all"]) == {4} and set(p["none"]) == {0} and set(p["zero"]) == {0}


def test_quotas_are_exact_and_draws_disjoint(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    m = mixing.mix(docs, block_words=16, shard_blocks=256)
    draws = m.draws.collect()
    quota = {(r["shard"], r["sid"]): r["quota"] for r in m.shard_quotas.collect()}
    per_shard = Counter(r["shard"] for r in draws)
    assert len(per_shard) > 4 and max(per_shard.values()) - min(per_shard.values()) <= 1 + len(per_shard)
    source = {r["row_no"]: r["source"] for r in m.sizes.collect()}
    order = sorted(set(source.values()))
    assert Counter((r["shard"], order.index(source[r["row_no"]])) for r in draws) == quota
    # a block is drawn in whole passes: no block twice in one pass
    assert len({(r["row_no"], r["block_no"], r["pass_no"]) for r in draws}) == len(draws)
    for s in per_shard:
        assert sorted(r["position"] for r in draws if r["shard"] == s) == list(range(1, per_shard[s] + 1))


def test_reruns_and_partitionings_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    def run(d):
        m = mixing.mix(d, block_words=32, shard_blocks=128)
        return sorted(map(tuple, m.draws.select("shard", "position", "doc_id", "pass_no", "block_no").collect()))
    assert run(docs) == run(docs.repartition(5)) == run(docs.coalesce(1))


def test_odd_rows(spark, odd_docs, no_docs):  # noqa: F811
    rows = mixing.taken_words(mixing.mix(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert mixing.taken_words(mixing.mix(no_docs)).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    times = Counter(map(tuple, mixed.collect()))
    assert max(times.values()) <= 6  # a repeated row stands for two
    assert mixing.mixed_documents(no_docs).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, target, got = Counter(), {}, defaultdict(int)
    for r in mixing.mix(docs, block_words=None).sizes.collect():
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len(brute.words(r["text"]))
    longest = max(len(brute.words(r["text"])) for r in docs.collect())
    assert all(abs(got[s] - target[s]) <= longest / 2 for s in sizes)
