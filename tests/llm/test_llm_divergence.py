"""Source divergence against a plain recount, and the perfect hash behind it."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from ledgerlens.llm import divergence, perfect_hash
from llm_fixtures import no_docs, odd_docs  # noqa: F401

TERM = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def plain(rows, min_docs=10, top=10):
    """(lang, source, text) rows -> (lang, source, part, item, value, rank)."""
    df, n, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(UPPER))
        groups.add((lang, source))
        df.update({(lang, t) for t in found})
        n[lang, source].update(found)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), k in df.items() if x == lang and k >= min_docs)
        own = sorted(g for g in groups if g[0] == lang)
        count = {g: {t: n[g][t] for t in kept} for g in own}
        count["all"] = {t: sum(n[g][t] for g in own) for t in kept}
        total = {g: sum(c.values()) for g, c in count.items()}
        p = {g: {t: 1 + 10 ** 9 * (c[t] + 2) // (total[g] + 2 * len(kept)) for t in kept} for g, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = [(o[1], sum(f(p[g][t], p[o][t]) for t in kept)) for o in own if o != g]
            terms = [(t, f(p[g][t], p["all"][t])) for t in kept if count[g][t] > 0 and p[g][t] > p["all"][t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(*g, part, item, value, i + 1) for i, (item, value) in enumerate(items[:last])}
    return out


def as_set(df):
    rows = df.collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] + ["été", "日本", "İx", "ſ", "K"]
    out = []
    for i in range(400):
        lang, source = ("en", "de", "")[i % 3], f"s{int(rng.integers(0, 5)) if i % 3 else 0}"
        skew = rng.random(len(words)) ** (2 + i % 5)
        out.append((lang, source, " 12,".join(rng.choice(words, rng.integers(0, 40), p=skew / skew.sum()))))
    out += [("en", "empty", None), ("fr", "a", "alone"), ("fr", "b", None), (None, None, "x" * 5000)] + [("de", "s1", "Same SAME same")] * 12
    return out


SCHEMA = "lang string, source string, text string"


def test_equals_the_plain_recount(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)
    assert as_set(divergence.audit(docs)) == want
    # small shards, sent a few at a time, and tasks that hand over early
    assert as_set(divergence.audit(docs, shard_keys=8, broadcast_bytes=700)) == want


def test_tasks_that_hold_little_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 8)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert as_set(divergence.audit(docs, min_docs=3, top_terms=4, shard_keys=16)) == plain(rows, 3, 4)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    for least in (1, 2, 10):
        assert as_set(divergence.audit(odd_docs, min_docs=least)) == plain(rows, least)
    empty = divergence.audit(no_docs)
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_terms_are_the_contract_s():
    text = "Ünï-Code AbC_9z [x]{y}~\x7f\x80é K\x00q @A"
    assert [t.decode() for t in divergence.terms(text.encode())] == TERM.findall(text.translate(UPPER))


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    whole = rng.integers(1, 2 ** 52, 2000)
    n = (whole * rng.random(2000)).astype(np.int64) + 1
    n = np.minimum(n, whole)
    assert divergence.shares(n, whole).tolist() == [1 + 10 ** 9 * int(a) // int(b) for a, b in zip(n, whole)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_perfect_hash_is_minimal_and_verified(n):
    keys = [f"key {i}".encode() for i in range(n)]
    built = perfect_hash.build(keys)
    assert sorted(built["keys"]) == sorted(keys) and len(built["bits"]) * 8 < max(64, 4 * n + 64)
    others = [f"other {i}".encode() for i in range(500)]
    lookup = perfect_hash.Lookup([built])
    low, high = perfect_hash.digests(keys + others)
    slots = lookup.slots(keys + others, np.zeros(n + 500, np.int64), low, high)
    assert sorted(slots[:n].tolist()) == list(range(n)) and (slots[n:] == -1).all()
    assert [lookup.keys[s] for s in slots[:n].tolist()] == keys


def test_colliding_placements_get_another_seed(monkeypatch):
    real = perfect_hash._placed
    monkeypatch.setattr(perfect_hash, "_placed", lambda low, high, seed: real(low, high, seed) if np.max(seed) > 1 else low * np.uint64(0))
    assert perfect_hash.build([b"a", b"b", b"c"])["seed"] == 2


def test_shards_together():
    keys = [f"k{i}".encode() for i in range(300)]
    low, high = perfect_hash.digests(keys)
    of = perfect_hash.shard_of(low, np.full(300, 7))
    shards = [perfect_hash.build([k for k, s in zip(keys, of) if s == i]) for i in range(7)] + [perfect_hash.build([])]
    lookup = perfect_hash.Lookup(shards)
    assert sorted(lookup.slots(keys, of, low, high).tolist()) == list(range(300))
