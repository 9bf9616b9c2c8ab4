"""Quality classifier: held-out ranking, flattened trees, and odd rows."""

import zlib

import numpy as np

from ledgerlens.llm import catalog, classifier
from llm_fixtures import MEDIUM, no_docs, odd_docs  # noqa: F401


def test_held_out_ranking(spark):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = catalog.op9_quality_classifier(spark, MEDIUM).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["score"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q != 1]
    assert len(bad) > 3 and np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_fit_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    a, b = classifier.fit(docs, labels), classifier.fit(docs.repartition(7), labels.repartition(3))
    assert (a.feature == b.feature).all() and (a.value == b.value).all()


def test_flattened_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = classifier.fit_trees(x, y, n_trees=15, depth=3)
    for i in range(0, 500, 25):
        total = t.base
        for k in range(len(t.feature)):
            node = 0
            while t.feature[k, node] >= 0:
                node = t.left[k, node] + (x[i, t.feature[k, node]] > t.threshold[k, node])
            total += t.value[k, node]
        assert np.isclose(t.raw(x[i:i + 1])[0], total)
    assert ((t.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_odd_rows(spark, odd_docs, no_docs):  # noqa: F811
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (6, 1), (7, 0), (99, 1), (1, 1)], "doc_id long, quality int")
    trees = classifier.fit(odd_docs, labels, min_rows=1)
    rows = classifier.score(odd_docs, trees, odd_docs.columns)
    assert rows.columns == [*odd_docs.columns, "quality_score"]
    got = rows.collect()
    assert len(got) == odd_docs.count() and all(0 <= r["quality_score"] <= 1 for r in got)
    assert classifier.score(no_docs, trees, ["doc_id"]).count() == 0
    none = classifier.fit(odd_docs, labels.limit(0))
    assert {r["quality_score"] for r in classifier.score(odd_docs, none, ["doc_id"]).collect()} == {0.5}
    one = classifier.fit(odd_docs, labels.filter("quality = 1"))
    assert min(r["quality_score"] for r in classifier.score(odd_docs, one, ["doc_id"]).collect()) > 0.5


def test_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    seen = []
    fit_trees = classifier.fit_trees
    try:
        classifier.fit_trees = lambda x, y, **k: seen.append(len(x)) or fit_trees(x, y, **k)
        classifier.fit(docs, labels, sample_rows=100)
    finally:
        classifier.fit_trees = fit_trees
    assert 50 <= seen[0] <= 150
