"""The corpus pipeline: each stage against a plain version on its own input."""

from collections import Counter

import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline as cp
from ledgerlens.llm import classifier
from ledgerlens.llm.catalog import held_out
from ledgerlens.llm.common import read_table, stored
from llm_fixtures import SMALL, no_docs, odd_docs  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark):
    docs = read_table(spark, SMALL, "documents")
    out = [docs]
    for _, f in cp.STAGES:
        out.append(stored(f(spark, out[-1], SMALL)))
    return out


def rows(df):
    return df.collect()


def test_stage_names_and_columns(stages):
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_classifier_rejects(spark, stages):
    trees = classifier.fit(stages[0], read_table(spark, SMALL, "labels").filter(~held_out()))
    import numpy as np
    want = {r["doc_id"] for r in rows(stages[0])
            if trees.score(np.array([classifier.text_statistics(r["text"])]))[0] >= 0.3}
    assert {r["doc_id"] for r in rows(stages[1])} == want and len(want) < stages[0].count()


def test_one_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in rows(stages[1])}
    want = {c for _, c in brute.components(texts, 5).values()}
    assert sorted(r["doc_id"] for r in rows(stages[2])) == sorted(want)


def test_passages_are_cut(stages):
    before = sorted((r["doc_id"], r["text"]) for r in rows(stages[2]))
    after = {r["doc_id"]: r for r in rows(stages[3])}
    assert len(after) == len(before)
    for (i, t), gone in zip(before, brute.removed_words(before)):
        assert brute.words(after[i]["text"]) == [w for j, w in enumerate(brute.words(t)) if j not in gone]
        assert after[i]["text"] == t if not gone else after[i]["n_chars"] == len(after[i]["text"])


def test_mix_reaches_targets(stages):
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in rows(stages[3])}
    source = {r["doc_id"]: r["source"] for r in rows(stages[3])}
    total, got = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
    times = Counter(r["doc_id"] for r in rows(stages[4]))
    assert max(times.values()) <= 3
    for i, k in times.items():
        got[source[i]] += k * size[i]
    for s, target in brute.targets(total).items():
        assert abs(got[s] - target) <= max(size.values()) / 2


def test_tokens_equal_library(stages):
    t = Tokenizer.from_file(cp.TOKENIZER)
    t.no_truncation()
    t.no_padding()
    text = {r["doc_id"]: r["text"] for r in rows(stages[3])}
    out = rows(stages[5])
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in rows(stages[4]))
    for r in out:
        assert r["ids"] == t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_run_equals_stages(spark, stages):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in rows(cp.run(spark, SMALL)))
    assert got == Counter((r["doc_id"], r["n_tokens"]) for r in rows(stages[5]))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):  # noqa: F811
    for docs in (odd_docs, no_docs):
        for _, f in cp.STAGES[:-1]:
            docs = stored(f(spark, docs, SMALL))
        assert docs.columns == odd_docs.columns
        coded = cp.STAGES[-1][1](spark, docs, SMALL)
        assert coded.count() == docs.count() and all(r["round_trip"] for r in coded.select("round_trip").collect())
