"""N-gram Jaccard join against all pairs on full sets."""

from collections import Counter

import numpy as np
import pytest

import brute
from ledgerlens.llm import catalog, ngram_join as J
from llm_fixtures import SMALL, no_docs, odd_docs  # noqa: F401


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = brute.components(texts, 5)
    assert as_dict(catalog.op13_ngram_jaccard_join(spark, SMALL)) == want
    assert any(i != c for i, (_, c) in want.items())


def near_copies(seed, n, words, most):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for j in rng.integers(0, words, rng.integers(0, most)):
            w[j] = f"z{rng.integers(0, 40)}"
        rows.append((i, " ".join(w[int(rng.integers(0, 4)):])))
    return rows + [(1000 + i, " ".join(f"q{rng.integers(0, 10 ** 6)}" for _ in range(30))) for i in range(20)]


@pytest.mark.parametrize("seed,words,most", [(5, 60, 3), (6, 12, 2), (7, 200, 9)])
def test_chunked_groups_lose_no_link(spark, seed, words, most):
    """One large near-copy group, with lists and components cut into many chunks."""
    rows = near_copies(seed, 120, words, most)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.components(dict(rows), 5)
    assert 1 < len({c for _, c in want.values()}) < len(rows)
    assert as_dict(J.join(docs, 5, list_chunk=16, set_chunk=1500)) == want
    assert as_dict(J.join(docs, 5)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = J.join(odd_docs, 5).collect()
    assert len(rows) == odd_docs.count()
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert got[(2, 56)] == 1 and got[(1, 56)] == 1 and got[(None, 57)] == 1
    assert got[(3, 0)] == 3 and got[(4, 0)] == 4 and got[(None, 0)] is None and got[(5, 0)] == 5
    assert got[(6, 1)] == 6 and got[(7, 1)] == 6  # A-Z count as a-z
    assert J.join(no_docs, 5).count() == 0


def test_many_rows_without_an_id(spark):
    rows = [(None, t) for _, t in near_copies(1, 60, 40, 2)]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert len(got) == len(rows) and all(r["component_id"] is None for r in got)


def test_merge_skip_counts_every_member():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lists = [sorted(rng.choice(60, rng.integers(0, 40), replace=False).tolist()) for _ in range(rng.integers(0, 12))]
        count = Counter(x for own in lists for x in own)
        for least in range(1, len(lists) + 2):
            assert J.merge_skip(lists, least) == {x: n for x, n in count.items() if n >= least}


def random_sets(rng, n=40):
    base = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    sets = []
    for _ in range(n):
        k = int(rng.integers(1, 60))
        own = base[:k] if rng.random() < .7 else base[200:200 + k]
        keep = own[rng.random(len(own)) < rng.choice([1, .95, .85])]
        extra = rng.integers(0, 2 ** 63, rng.integers(0, 4)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([keep, extra, own[:1]])))
    return sets


def linked(a, b, percent):
    shared = len(np.intersect1d(a, b))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


@pytest.mark.parametrize("percent", [50, 80, 93, 100])
def test_prefixes_and_bitmaps_keep_every_link(percent):
    rng = np.random.default_rng(percent)
    seen = 0
    for _ in range(15):
        sets = random_sets(rng)
        maps = [len(s).to_bytes(8, "little") + J.parity_bitmap(s).tobytes() for s in sets]
        f = J.BitmapFilter(percent)
        d = f.load(maps)
        for i, a in enumerate(sets):
            near = f.near(d, i, np.arange(len(sets)))
            for j, b in enumerate(sets):
                if linked(a, b, percent):
                    seen += 1
                    assert near[j]
                    assert len(np.intersect1d(a, b)) >= J.needed(len(a), len(b), percent)
                    p, q = (x[:int(J.prefix_length(len(x), percent))] for x in (a, b))
                    shared = len(np.intersect1d(p, q))
                    assert shared >= max(J.spare(len(a), percent), J.spare(len(b), percent))
    assert seen > 500


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_occurrence_search_equals_intersection(percent):
    rng = np.random.default_rng(percent)
    for _ in range(6):
        sets = random_sets(rng)
        search = J.OccurrenceLinker(percent)
        d = search.load([s.tobytes() for s in sets])
        for _ in range(60):
            i = int(rng.integers(0, len(sets)))
            rest = np.flatnonzero(rng.random(len(sets)) < rng.choice([.1, .5, 1]))
            assert search.near(d, i, rest).tolist() == [linked(sets[i], sets[j], percent) for j in rest]


def test_large_bitmaps_are_folded():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2 ** 63, 300).astype(np.uint64))
    b = np.append(a, rng.integers(0, 2 ** 63, 40).astype(np.uint64))
    small, large = J.parity_bitmap(a), J.parity_bitmap(np.unique(b))
    assert len(large) == len(small) or J.folded(large, len(small)).shape == small.shape
    assert np.bitwise_count(J.folded(J.parity_bitmap(np.unique(np.tile(b, 1))), len(small)) ^ small).sum() <= 40
