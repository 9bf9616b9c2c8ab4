"""Cross-tokenizer alignment against a plain version on the libraries' own encodings."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import alignment, catalog
from ledgerlens.llm.bpe import Codec
from llm_fixtures import SMALL, no_docs, odd_docs  # noqa: F401

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B), Codec(open(A, encoding="utf-8").read()).table()


def plain(texts, libraries):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    tok, pieces, table = libraries
    rows, links = [], []
    for x in texts:
        a = tok.encode(" " + x, add_special_tokens=False).ids if x else []
        b = pieces.encode(x) if x else []
        bytes_a = [table[i] for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
                   else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not x or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + x.encode():
            a = b = []
        ends_a = {int(e): i for i, e in enumerate(np.cumsum([len(t) for t in bytes_a]))} if a else {}
        ends_b = {int(e): i for i, e in enumerate(np.cumsum([len(t) for t in bytes_b]))} if b else {}
        groups, own, i, j = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            groups.append(",".join(map(str, a[i:ends_a[e] + 1])) + "|" + ",".join(map(str, b[j:ends_b[e] + 1])))
            i, j = ends_a[e] + 1, ends_b[e] + 1
            own.append((a[i - 1], b[j - 1]))
        links.append(own)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(x for own in links for x in own)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(*r[:3], len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), r[3]) for r, own in zip(rows, links)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def digests(docs, **limits):
    aligned = alignment.align(docs, A, B).cache()
    return alignment.link_strength(aligned, alignment.link_counts(aligned), digest=True, **limits)


def test_query_equals_plain_version(spark, libraries):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in catalog.op12_cross_tokenizer_alignment(spark, SMALL).collect()}
    assert len(got) == len(docs)
    assert [got[d["doc_id"]] for d in docs] == plain([d["text"] for d in docs], libraries)


ODD_TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b \n c", "▁", "a▁b", " ▁ x", "<0x41> <s> </s> <unk> <|endoftext|>",
             "İstanbul ﬁ ² ½ é", "日本語 テキスト", "😀 👨‍👩‍👧", "x" * 3000, "\t\ttab\r\n", "\x00\x01 nul", "�", "word " * 2000, "a" * 9 + " " * 40 + "b"]


def test_odd_texts(spark, libraries):
    rows = [(i, t, 1, 2) for i, t in enumerate(ODD_TEXTS * 2)]  # every text twice
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_a int, ids_a int").repartition(3)
    want = plain([r[1] for r in rows], libraries)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in digests(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert want[0] == (0, 0, 0, 0, 0, 0, "") and want[9][0] == 0 and want[12][0] > 0
    aligned = alignment.align(docs, A, B)
    apart = alignment.group_digests(alignment.link_strength(aligned, alignment.link_counts(aligned)))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in apart.collect()} == got
    # pairs sent in many rounds
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in digests(docs, broadcast_pairs=40).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_long_texts_go_in_stretches(libraries, monkeypatch):
    codec = alignment.PieceCodec(open(B, "rb").read())
    assert codec.separable
    monkeypatch.setattr(alignment, "LONG_TEXT", 7)
    texts = [t for t in ODD_TEXTS if t and "▁" not in t] + ["a b c d e f g h i j   k l ", "one two  three   four ", " \n x y z  "]
    assert [x.tolist() for x in codec.encode(texts)] == [libraries[1].encode(t) for t in texts]


def test_odd_rows(spark, odd_docs, no_docs, libraries):
    rows = odd_docs.withColumn("ids_b", F.lit("mine")).collect()
    got = digests(odd_docs.withColumn("ids_b", F.lit("mine")))
    assert {"extra", "kind"} <= set(got.columns) and "ids_b" not in got.columns
    want = plain([r["text"] for r in rows], libraries)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(want)
    assert digests(no_docs).count() == 0


def test_groups_are_the_texts(spark):
    """Ids and sizes, the operator's real output, spell every group alike on both sides."""
    docs = spark.createDataFrame([(1, "The naïve café: 12345 tokens, <|endoftext|>!")], "doc_id int, text string")
    r = alignment.align(docs, A, B).first()
    aligner = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    table_a, table_b = aligner.a.table(), aligner.b.table
    i = j = 0
    text = b""
    for a, b in zip(r["sizes_a"], r["sizes_b"]):
        mine = b"".join(table_a[x] for x in r["ids_a"][i:i + a])
        assert mine == b"".join(table_b[x] for x in r["ids_b"][j:j + b])
        text, i, j = text + mine, i + a, j + b
    assert text.decode() == " The naïve café: 12345 tokens, <|endoftext|>!" and i == len(r["ids_a"]) and j == len(r["ids_b"])


def test_common_groups_are_found_in_arrays(monkeypatch):
    # no Python object per token: that is what the step cost
    monkeypatch.setattr(alignment, "dict", None, raising=False)
    rng = np.random.default_rng(5)
    for _ in range(50):
        total = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 20)), total)) for _ in range(2))
        upto_a, upto_b = alignment.common_groups(a, b)
        want = sorted(set(a.tolist()) & set(b.tolist()))
        assert upto_a.tolist() == [a.tolist().index(e) + 1 for e in want]
        assert upto_b.tolist() == [b.tolist().index(e) + 1 for e in want]
    assert all(len(x) == 0 for x in alignment.common_groups(a[:0], b))
    assert all(len(x) == 0 for x in alignment.common_groups(a, b[:0]))
