"""Substring dedup against window-by-window counting."""

import numpy as np
from pyspark.sql import functions as F

import brute
from llm_fixtures import SMALL, no_docs, odd_docs  # noqa: F401
from ledgerlens.llm import catalog, substrings
from ledgerlens.llm.hashing import Words


def check(rows, got):
    """got: (doc_id, text) -> (n_words, n_removed, kept words)"""
    for (i, t), gone in zip(rows, brute.removed_words([(2 ** 63 - 1 if i is None else i, t) for i, t in rows])):
        w = brute.words(t)
        assert got[(i, t)] == (len(w), len(gone), [x for j, x in enumerate(w) if j not in gone]), (i, (t or "")[:80])


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in catalog.op6_substring_dedup(spark, SMALL).collect()}
    for (i, t), gone in zip(rows, brute.removed_words(rows)):
        w = brute.words(t)
        assert got[i] == (len(w), len(gone), brute.sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sum(r[1] for r in got.values()) > 0


def dedup_rows(docs, **kw):
    cut = substrings.dedup(docs.withColumn("given", F.col("text")), **kw)
    return {(r["doc_id"], r["given"]): (r["n_words"], r["n_removed"], brute.words(r["text"])) for r in cut.collect()}


def test_overlapping_passages(spark):
    """Short alphabets make windows repeat within and across documents, at odd offsets."""
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(rng.choice(list("ab"), int(rng.integers(0, 90))))) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(70))
    rows += [(100 + i, f"{'x' * i} {passage} y{i} " + " ".join(f"u{i}_{j}" for j in range(30))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, dedup_rows(docs.repartition(7)))
    check(rows, dedup_rows(docs.coalesce(1)))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(rows, dedup_rows(odd_docs))
    out = substrings.dedup(odd_docs)
    assert out.columns == odd_docs.columns + ["n_words", "n_removed", "spans"]
    assert substrings.dedup(no_docs).count() == 0


def test_layout_of_kept_text_stays():
    assert substrings.cut_words("a b\n\nc  d e", [(1, 3)]) == "a d e"
    assert substrings.cut_words(" a\nb c ", [(0, 1)]) == " b c "
    assert substrings.cut_words("a b c", [(2, 3)]) == "a b "


def test_words_follow_the_definition():
    texts = ["a\x1cb c", "", "  x\ty\x0bz\x0c\r\n", "é ü 日本"]
    w = Words([t.encode() for t in texts])
    assert w.counts.tolist() == [len(brute.words(t)) for t in texts]
    same = Words([b"zz x\ty", b"y"])
    assert same.hash[1] == w.hash[2] and same.hash[2] == same.hash[3] == w.hash[3]
