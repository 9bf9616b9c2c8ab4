"""BPE against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import brute
from ledgerlens.llm import bpe, catalog
from llm_fixtures import SMALL, no_docs, odd_docs  # noqa: F401

PIECES = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "'s", "'ll", "don't", "1", "23", "!!", "!", "'", "<|endoftext|>",
          "日本", "　", "́", "😀", "Ġ", "aaaa", "    ", "\x1c", "\xa0", "-", "_", "ZZ", "İ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(catalog.TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def test_query_equals_library(spark, library):
    encode, decode = library
    rows = {r["doc_id"]: r for r in catalog.op7_bpe(spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids, r = encode(d["text"] or ""), rows.pop(d["doc_id"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == brute.sha(decode(ids))
    assert not rows


def test_tree_concatenation(library):
    """Random texts, many without a place to split, cut down to leaves of a few characters."""
    encode, decode = library
    rnd = random.Random(7)
    codec = bpe.Codec(open(catalog.TOKENIZER, encoding="utf-8").read(), leaf_chars=24)
    for _ in range(400):
        some = rnd.choice([PIECES, ["a", "the", "x", "é"], [" ", "  ", "\n", "a"], ["="], ["ab"], ["日", "本"]])
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 300)))
        want = encode(text)
        assert codec.encode_tree(text) == want
        assert np.frombuffer(codec.encode_texts([text])[0], np.int32).tolist() == want
        assert codec.decode(np.array(want, np.int32)) == decode(want)


def test_pieces_over_tasks(spark, odd_docs, no_docs, library):  # noqa: F811
    encode, _ = library
    out = bpe.encode(odd_docs, catalog.TOKENIZER, leaf_chars=64, piece_chars=700)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "ids"])
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert list(r["ids"]) == encode(r["text"] or "")
    assert {r["doc_id"] for r in rows if len(r["text"]) > 700} == {8, 9, 10}
    assert bpe.encode(no_docs, catalog.TOKENIZER).count() == 0


def test_decode_odd_ids(spark, library):
    _, decode = library
    rows = [(1, [220, 50256, 187]), (2, None), (3, []), (4, [-1, 10 ** 6, 64]), (5, [None, 64]), (6, [187, 222, 110])]
    df = spark.createDataFrame(rows, "decoded int, ids array<int>")
    got = [r["decoded"] for r in bpe.decode(df, catalog.TOKENIZER).collect()]
    assert got == [decode([220, 50256, 187]), "", "", decode([64]), decode([64]), decode([187, 222, 110])]
