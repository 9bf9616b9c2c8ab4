"""Words that collide under polynomial hashes modulo 2 ** 64, and texts that share a CRC-32."""

import zlib

import numpy as np

import brute
from ledgerlens.llm import hashing, minhash, mixing, ngram_join, substrings


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_of_two_letters_stay_apart(spark):
    """A sequence and its complement have equal polynomial hashes for every odd base."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 1 + [f"{one[:-1]}{i}" for i in range(24)])), (2, " ".join([two] + [f"{two[:-1]}{i}" for i in range(24)])),
            (3, f"{one} x y z u"), (4, f"{two} x y z u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (minhash.near_duplicates(docs, 4), ngram_join.join(docs, 5)):
        assert {r["doc_id"]: r["component_id"] for r in df.collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup(docs, 20).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    words = hashing.Words([one.encode(), two.encode()])
    assert words.hash[0] != words.hash[1] and words.second[0] != words.second[1]


def test_word_hashes_depend_on_the_word_alone():
    rng = np.random.default_rng(0)
    words = list({bytes(rng.integers(97, 100, rng.integers(1, 300)).astype(np.uint8)) for _ in range(3000)} | {b"x" * n for n in range(1, 600)})
    alone = [int(hashing.Words([w]).hash[0]) for w in words]
    together = hashing.Words([b"  ".join(words[:1000]), b" " + b"\n".join(words[1000:]) + b"\t"])
    assert together.hash.tolist() == alone and len(set(alone)) == len(words)
    assert len(set(together.second.tolist())) == len(words) and not set(together.second.tolist()) & set(alone)
    assert len(hashing.Words([]).hash) == 0 and len(hashing.Words([b"", b" \n"]).second) == 0


def crc_twins():
    """Two texts of equal CRC-32, one with a passage of another document."""
    seen = {}
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(25))
    while True:
        for kind, text in ((0, f"{passage} {rng.integers(0, 2 ** 62)}"), (1, " ".join(map(str, rng.integers(0, 10 ** 6, 24))) + f" {rng.integers(0, 2 ** 40)}")):
            other = seen.setdefault(zlib.crc32(text.encode()), (kind, text))
            if other[0] != kind:
                return passage, other[1] if kind else text, text if kind else other[1]


def test_texts_of_equal_crc_are_different_rows(spark):
    passage, a, b = crc_twins()
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    for key in (7, None):
        rows = [(1, passage, "s"), (key, a, "s"), (key, b, "s")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r["text"]: r["n_removed"] for r in substrings.dedup(docs, 20).collect()}
        assert got[b] == 0 and sum(got.values()) == 25 and got[passage] == 0
        mixed = [r["text"] for r in mixing.mixed_documents(docs, (5,), 1).collect()]
        assert sorted(mixed) == sorted([passage, a, b])
        if key:
            want = [len(x) for x in brute.removed_words([(i, t) for i, t, _ in rows])]
            assert sorted(got.values()) == sorted(want)
