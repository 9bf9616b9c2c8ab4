"""Quality rules: base counts by brute force, sketches, and junk against clean documents."""

import numpy as np
from pyspark.sql import functions as F

import brute
from ledgerlens.llm import catalog, quality_rules
from llm_fixtures import MEDIUM, no_docs, odd_docs  # noqa: F401


def test_query_counts_and_verdicts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = catalog.op8_quality_rules(spark, MEDIUM).collect()
    assert len(rows) == len(docs)
    good, bad = [], []
    for r in rows:
        counts = tuple(r[c] for c in quality_rules.BASE_COLUMNS)
        assert counts == brute.base_counts(docs[r["doc_id"]])
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in quality and not r["base_failed"]:
            (good if quality[r["doc_id"]] == 1 else bad).append(r["kept"])
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_sketch_quantiles(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros(300), rng.lognormal(0, 2, 3000)])
    m = spark.createDataFrame([(float(v),) for v in x], "v double").select(
        F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit("m").alias("measure"), "v")
    gamma = np.log((1 + quality_rules.SKETCH_ERROR) / (1 - quality_rules.SKETCH_ERROR))
    s = m.withColumn("bin", F.when(F.col("v") > 0, F.ceil(F.log("v") / gamma))).groupBy(
        "lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))
    halves = s.withColumn("n", F.col("n") * 2)
    for sketch in (s, halves.union(s)):  # merging adds counts
        got = quality_rules.quantiles(sketch, ["lang"], {"a": 0.05, "b": 0.5, "c": 0.9}).first()
        for name, q in (("a", 0.05), ("b", 0.5), ("c", 0.9)):
            exact = np.quantile(x, q, method="inverted_cdf")
            assert abs(got[name] - exact) <= 0.021 * exact


def test_thresholds_follow_the_group(spark):
    """A source full of digits and symbols keeps its usual documents; the same text elsewhere goes."""
    plain = " ".join(f"word{chr(97 + i % 20)}{i}" for i in range(40))
    signs = " ".join(f"#v{i} | x{i}" for i in range(40))
    rows = [(i, plain.replace("word", f"w{i}"), "en", "prose") for i in range(200)]
    rows += [(1000 + i, signs.replace("v", f"v{i}"), "en", "tables") for i in range(200)]
    rows += [(5000, signs, "en", "prose")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0]["kept"] and got[1000]["kept"] and not got[5000]["kept"]
    assert got[5000]["broken_rules"] == ["symbol_share"]


def test_odd_rows(odd_docs, no_docs):  # noqa: F811
    rows = quality_rules.judge(odd_docs).collect()
    texts = sorted(brute.base_counts(r["text"]) for r in odd_docs.collect())
    assert sorted(tuple(r[c] for c in quality_rules.BASE_COLUMNS) for r in rows) == texts
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 10)
    assert quality_rules.judge(no_docs).count() == 0


def test_fences_against_plain_quantiles(spark):
    """Fences of a dense, a rare and an absent measure, against sorted values."""
    rng = np.random.default_rng(1)
    values = {"word_length": rng.lognormal(1.6, 0.1, 400), "symbol_share": np.where(rng.random(400) < 0.1, rng.random(400), 0.0),
              "mark_share": np.zeros(400)}
    rows = [(m, float(v)) for m, x in values.items() for v in x]
    gamma = np.log((1 + quality_rules.SKETCH_ERROR) / (1 - quality_rules.SKETCH_ERROR))
    sketch = spark.createDataFrame(rows, "measure string, v double").select(
        F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), "measure",
        F.when(F.col("v") > 0, F.ceil(F.log("v") / gamma)).alias("bin")).groupBy(
        "lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))
    got = quality_rules.thresholds(sketch, 50).first()
    assert got["t_lang"] == "en" and got["t_source"] is None
    for m, x in values.items():
        low, high = np.quantile(x, [0.25, 0.75], method="inverted_cdf")
        some = x[x > 0]
        spread = high - low if high > 0 else len(some) / len(x) * np.quantile(some, 0.25, method="inverted_cdf") if len(some) else 0
        exact = high + quality_rules.SPREADS * spread + quality_rules.FLOOR[m]
        assert abs(got[f"max_{m}"] - exact) <= 0.15 * spread * quality_rules.SPREADS + 0.021 * 7 * high + 1e-12


def test_first_occurrences_are_no_evidence(spark):
    """One repeated line passes where none is usual; many do not."""
    lines = [" ".join(f"{chr(97 + i % 26)}w{i}x{j}" for j in range(8)) for i in range(20)]
    rows = [(i, "\n".join(f"d{i} {x}" for x in lines), "en", "a") for i in range(100)]
    rows += [(500, "\n".join([*lines, "end of it", "end of it"]), "en", "a"),
             (501, "\n".join([*lines, *["end of it"] * 8]), "en", "a")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0]["kept"] and got[500]["kept"] and not got[501]["kept"]
    assert "dup_line_share" in got[501]["broken_rules"]
