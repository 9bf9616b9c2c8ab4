"""Language identification: held-out accuracy, spans, scripts and odd rows."""

import zlib

import numpy as np
import pytest

from llm_fixtures import MEDIUM, no_docs, odd_docs  # noqa: F401
from ledgerlens.llm import catalog, language


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{MEDIUM}/documents.parquet").filter(~catalog.held_out()))


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = catalog.op2_language_id(spark, MEDIUM).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_spans_of_mixed_text(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").filter(
        "length(text) > 600 and length(text) < 3000 and lang in ('en', 'de') and text not like '%|%'").collect()}
    en, de = docs["en"].split()[:60], docs["de"].split()[:60]
    spans = language.text_spans(model, " ".join(en + de))
    assert [s[2] for s in spans] == ["en", "de"]
    assert spans[0][0] == 0 and abs(spans[0][1] - 60) <= 8


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(6, 3)).astype(np.float32) * 3
    import itertools
    def value(path):
        return sum(scores[i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
    best = max(itertools.product(range(3), repeat=6), key=value)
    both = np.concatenate([scores[:2], scores])
    got = language.viterbi(both, np.array([0, 2, 2, 8]), 1.5)
    assert tuple(got[2:]) == best


def test_scripts_narrow_candidates(spark):
    rows = [("да нет это он", "ru"), ("the of and is", "en"), ("το και είναι", "el")]
    m = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "совсем другое"), (2, "something else"), (3, "άλλο"), (4, "漢字")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, m).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["ru", "en", "el"] and got[4] in ("ru", "en", "el")


def test_odd_rows(spark, odd_docs, no_docs, model):
    rows = language.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for i in (3, 4, 5):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0
    assert by_id[12]["lang_pred"] == "und"  # digits and signs only
    assert language.predict(no_docs, model).count() == 0
    assert language.learn(no_docs) is None
    assert {r["lang_pred"] for r in language.predict(odd_docs, None).collect()} == {"und"}
    learned = language.learn(odd_docs)
    assert learned["langs"] == sorted(learned["langs"])


def test_long_words_count_whole():
    """Words beyond the matrix width are scored in stretches, none of it left out."""
    grams = np.random.default_rng(0).normal(size=(1 << language.HASH_BITS, 2)).astype(np.float32)
    m = {"langs": ["a", "b"], "scores": grams, "scripts": np.ones((2, language.N_SCRIPTS), bool)}
    one, two = "x" * 24, "y" * 24
    both = language.score_words(m, [one, two, one + two])
    assert np.allclose(both[2], both[0] + both[1], atol=1e-3)


def test_a_language_without_the_script_is_never_chosen(spark):
    """A language learned from little, in another script, takes no unknown word of a much larger one."""
    rows = [("the quick brown fox jumps over the lazy dog and runs away " * 400, "en"), ("да нет это он", "ru")]
    m = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["zqxvkzj zqxvkzj zqxvkzj zqxvkzj zqxvkzj", "zqxvkzj wqqx", "жщъыэ", "дdddd zzq", "жжжd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, m).collect()}
    assert got == {0: "en", 1: "en", 2: "ru", 3: "en", 4: "ru"}  # most letters name a word's script
    scores = language.score_words(m, ["zqxvkzj", "жщъыэ", "漢字"])
    assert np.isneginf(scores[0]).tolist() == [False, True] and np.isneginf(scores[1]).tolist() == [True, False]
    assert np.isfinite(scores[2]).all()


def test_unknown_words_do_not_favour_small_corpora(spark):
    rows = [("the quick brown fox jumps over the lazy dog and runs away " * 400, "en"), ("vad heter du", "sv")]
    m = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    en, sv = language.score_words(m, ["zzxxqq"])[0]
    assert sv - en < 1.0


def test_word_scores_equal_a_plain_sum(model):
    """Scores per word against a loop over its n-grams, each hashed by itself."""
    words = ["the", "straße", "a", "żółć", "internationalisation"]
    got = language.score_words(model, words)
    for i, w in enumerate(words):
        marked = [1, *map(ord, w), 1]
        total = np.zeros(len(model["langs"]))
        for n in (2, 3, 4):
            for a in range(len(marked) - n + 1):
                cell, real = language._grams(np.array([marked[a:a + n]], np.uint32), n)
                assert real.all()
                total += model["scores"][cell[0, 0]] / 3
        assert np.allclose(got[i], total, atol=1e-2)


def test_long_texts_in_stretches(spark, model, monkeypatch):
    """A text beyond the slice is labelled as if it were held whole, wherever it is cut."""
    docs = [r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").filter(
        "length(text) > 300 and length(text) < 3000").limit(40).collect()]
    text = "\n".join(docs) + " 　 1234 " * 50
    _, whole, letters = language._label_texts(model, [text], 8.0)
    spans = language.text_spans(model, text)
    want = language.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    for size in (50, 777, 20_000):
        monkeypatch.setattr(language, "SLICE_CHARS", size)
        assert "".join(language._stretches(text)) == text
        parts = list(language._label_stretches(model, text, 8.0))[::-1]
        assert len(parts) > 1
        assert np.array_equal(np.concatenate([a for a, _ in parts]), whole)
        assert np.array_equal(np.concatenate([b for _, b in parts]), letters)
        assert language.text_spans(model, text) == spans
    monkeypatch.setattr(language, "SLICE_CHARS", 5_000)
    # the closure of a local run reads the patched size only where it runs in this process
    monkeypatch.setattr(language, "map_batches", lambda df, run, schema: df.sparkSession.createDataFrame(
        [row for b in run(iter(df.toArrow().to_batches())) for row in b.to_pylist()], schema))
    assert language.predict(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"),
                            model).filter("doc_id = 1").collect() == want
