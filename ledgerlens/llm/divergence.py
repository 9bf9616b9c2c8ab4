"""Source divergence audit by a minimal-perfect-hash recount.

1. First pass over whole texts: in how many documents of its language every term occurs,
   pre-aggregated in each task, added up exactly. A language keeps its terms of at least
   ``min_docs`` documents.
2. The kept terms are dealt over shards of about ``SHARD_KEYS``; each shard's minimal perfect
   hash is built by one task. Shards are broadcast with their keys, at most ``BROADCAST_BYTES``
   at a time: a vocabulary beyond that is recounted in several passes over the texts, each with
   its own shards, so that no size is too large and nothing is dropped.
3. Recount: a term's slot follows from the perfect hash, the key stored there is compared, and
   the slot of the document's group (language, source) is incremented in a dense array. Tasks
   hold at most ``DENSE_SLOTS`` slots; beyond that they hand over what they have.
4. Smoothed shares of every group and language, their divergences in integers, and ranks.

A term is a run of ASCII letters and non-ASCII characters, only A-Z lower-cased. Divergence of
one term with shares p and q (in parts of a thousand million): floor((p-q)^2 / (p+q)).

Defined cases: null text, language and source read as empty; a group without terms counts with
every share at its floor; a language without kept terms has pairs of value 0; repeated rows
count as documents of their own; an empty table gives no rows; other columns are ignored. The
result holds a row for each ordered pair of a language's sources, so work grows with the square
of the number of sources of one language.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, ship_package, stored
from .hashing import text_batches
from .perfect_hash import Lookup, build, digests, shard_of

SHARE = 1_000_000_000
BATCH_BYTES = 1_000_000
SHARD_KEYS = 4096
PENDING_TERMS = 300_000
DENSE_SLOTS = 4_000_000
BROADCAST_BYTES = 16_000_000
BLOCK_CELLS = 1_000_000
# letters A-Z become a-z, other ASCII characters separate terms, non-ASCII bytes stay
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(TERM_BYTES).split()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _text_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def document_frequencies(docs: DataFrame) -> DataFrame:
    """Rows (lang, term, n_docs): in how many documents of its language a term occurs."""
    def count(batches):
        pending: dict[str, Counter] = {}

        def rows():
            for lang, c in pending.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), _text_column(list(c)), pa.array(list(c.values()), pa.int64())],
                    names=["lang", "term", "n_docs"])
            pending.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, texts in text_batches(batch.column(1), BATCH_BYTES):
                for lang, text in zip(langs[a:b], texts):
                    pending.setdefault(lang, Counter()).update(set(terms(text)))
                if sum(map(len, pending.values())) > PENDING_TERMS:
                    yield from rows()
        yield from rows()

    partial = map_batches(_keyed(docs).select("lang", "text"), count, "lang string, term string, n_docs long")
    return partial.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))


def hash_shards(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard of kept terms (lang, term): the built perfect hash and its keys by slot."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_keys).cast("int").alias("n_shards"))

    def deal(batches):
        for batch in batches:
            low, _ = digests(batch.column(1).cast(pa.binary()).to_pylist())
            n = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2),
                                              pa.array(shard_of(low, n).astype(np.int32))],
                                             names=["lang", "term", "n_shards", "shard"])

    def make(table: pa.Table) -> pa.Table:
        built = build(table.column("term").cast(pa.binary()).to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "n_shards": table.column("n_shards").slice(0, 1),
                         "shard": table.column("shard").slice(0, 1), "seed": pa.array([built["seed"]], pa.int32()),
                         "sizes": pa.array([built["sizes"]], pa.list_(pa.int32())),
                         "bits": pa.array([built["bits"]], pa.binary()),
                         "keys": pa.array([[k.decode() for k in built["keys"]]], pa.list_(pa.string()))})

    dealt = map_batches(kept.select("lang", "term").join(sizes, "lang").select("lang", "term", "n_shards"), deal,
                        "lang string, term string, n_shards int, shard int")
    return dealt.groupBy("lang", "shard").applyInArrow(
        make, "lang string, n_shards int, shard int, seed int, sizes array<int>, bits binary, keys array<string>")


def _rounds(shards: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``shards`` with a column round, so that the shards of a round fit into one broadcast."""
    n_bytes = F.octet_length("bits") + F.octet_length(F.array_join("keys", "")) + 8 * F.size("keys") + 64
    sized = shards.select("lang", "shard", n_bytes.cast("long").alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_rounds = max(1, -(-total // limit))
    while True:
        number = F.pmod(F.xxhash64("lang", "shard"), F.lit(n_rounds)).cast("int")
        largest = sized.groupBy(number.alias("round")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
        # one shard alone is within a few times SHARD_KEYS keys
        if n_rounds == 1 or not largest.filter((F.col("n") > limit) & (F.col("k") > 1)).take(1):
            return shards.withColumn("round", number), n_rounds
        n_rounds *= 2


class _Index:
    """The shards of one round as the tasks use them."""

    def __init__(self, rows: list):
        self.lookup = Lookup([{"seed": r["seed"], "sizes": r["sizes"], "bits": bytes(r["bits"]),
                               "keys": [k.encode() for k in r["keys"]]} for r in rows])
        self.n_shards = {r["lang"]: r["n_shards"] for r in rows}
        self.number = {(r["lang"], r["shard"]): i for i, r in enumerate(rows)}
        self.shard = np.array([r["shard"] for r in rows], np.int32)
        self.first = self.lookup.first
        # where a language's shards lie in this round (-1: in another round)
        self.places = {lang: np.array([self.number.get((lang, s), -1) for s in range(n)], np.int64)
                       for lang, n in self.n_shards.items()}
        self.spans: dict[str, tuple[int, int]] = {}
        ends = np.append(self.first[1:], len(self.lookup.keys)) if len(rows) else np.zeros(0, np.int64)
        for i, r in enumerate(rows):  # rows are ordered by language
            a, _ = self.spans.get(r["lang"], (int(self.first[i]), 0))
            self.spans[r["lang"]] = (a, int(ends[i]))

    def slots(self, lang: str, keys: list[bytes]) -> np.ndarray:
        """Slots in the language's own dense array; -1 for a term that is not kept."""
        low, high = digests(keys)
        place = self.places[lang][shard_of(low, self.n_shards[lang])]
        here = np.flatnonzero(place >= 0)
        slot = np.full(len(keys), -1, np.int64)
        slot[here] = self.lookup.slots([keys[i] for i in here.tolist()], place[here], low[here], high[here])
        return np.where(slot >= 0, slot - self.spans[lang][0], -1)


_INDEX: dict[str, _Index] = {}


def _index(key: str, sent) -> _Index:
    """One index per worker process."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = _Index(sent.value)
    return _INDEX[key]


def recount(docs: DataFrame, rows: list) -> DataFrame:
    """Rows (lang, source, shard, slot, n): occurrences of the terms of ``rows`` (shards of a
    round, ordered by language and shard) in each group."""
    sent, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def count(batches):
        index = _index(key, sent)
        dense: dict[tuple[str, str], np.ndarray] = {}
        pending: dict[tuple[str, str], Counter] = {}

        def place():
            for (lang, source), c in pending.items():
                keys = list(c)
                slots = index.slots(lang, keys)
                kept = slots >= 0
                if not kept.any():
                    continue
                group = dense.get((lang, source))
                if group is None:
                    a, b = index.spans[lang]
                    dense[(lang, source)] = group = np.zeros(b - a, np.int64)
                group[slots[kept]] += np.fromiter(c.values(), np.int64, len(c))[kept]
            pending.clear()

        def handed_over():
            for (lang, source), group in dense.items():
                slots = np.flatnonzero(group)
                at = slots + index.spans[lang][0]
                shard = np.searchsorted(index.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(slots), pa.string()), pa.array([source] * len(slots), pa.string()),
                     pa.array(index.shard[shard]), pa.array((at - index.first[shard]).astype(np.int32)), pa.array(group[slots])],
                    names=["lang", "source", "shard", "slot", "n"])
            dense.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in text_batches(batch.column(2), BATCH_BYTES):
                for lang, source, text in zip(langs[a:b], sources[a:b], texts):
                    if lang in index.spans:
                        pending.setdefault((lang, source), Counter()).update(terms(text))
                if sum(map(len, pending.values())) > PENDING_TERMS:
                    place()
                    if sum(map(len, dense.values())) > DENSE_SLOTS:
                        yield from handed_over()
        place()
        yield from handed_over()

    counted = map_batches(_keyed(docs), count, "lang string, source string, shard int, slot int, n long")
    return counted.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(1e9 * (n + 2) / (total + 2 * kept)), exactly."""
    return F.expr(f"1 + (CAST({SHARE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(19,0))) "
                  f"div CAST({total} + 2 * {kept} AS DECIMAL(19,0))")


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * n / whole) for n <= whole, by long division in base 1000."""
    out, rest = np.zeros(np.broadcast(n, whole).shape, np.int64), n
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def audit(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, shard_keys: int = SHARD_KEYS,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per group (lang, source) of ``docs`` (lang, source, text): its divergence from every other
    source of the language (part ``pair``) and the terms that set it apart from the language
    (part ``term``, the first ``top_terms``): lang, source, part, item, value, rank."""
    ship_package(docs.sparkSession)
    kept = document_frequencies(docs).filter(F.col("n_docs") >= min_docs)
    shards, n_rounds = _rounds(stored(hash_shards(kept, shard_keys)), broadcast_bytes)
    counted = None
    for i in range(n_rounds):
        rows = shards.filter(F.col("round") == i).drop("round").orderBy("lang", "shard").collect()
        if rows:
            part = recount(docs, rows)
            counted = part if counted is None else counted.union(part)
    if counted is None:
        counted = docs.sparkSession.createDataFrame([], "lang string, source string, shard int, slot int, n long")
    counted = stored(counted)

    per_lang = shards.groupBy("lang").agg(F.sum(F.size("keys")).cast("long").alias("v"))
    groups = (_keyed(docs).select("lang", "source").distinct()
              .join(counted.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(per_lang, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"),
                      (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("no")))
    groups = stored(groups)
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("n_sources"))

    # terms that set a group apart from its language
    of_lang = counted.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("lang_n"))
    words = shards.select("lang", "shard", F.posexplode("keys").alias("slot", "term"))
    both = (counted.join(of_lang, ["lang", "shard", "slot"]).join(groups, ["lang", "source"]).join(langs, "lang")
            .withColumn("p", _share("n", "total", "v")).withColumn("q", _share("lang_n", "lang_total", "v"))
            .filter("p > q").join(words, ["lang", "shard", "slot"])
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                    F.expr("((p - q) * (p - q)) div (p + q)").alias("value")))

    # every pair of sources: blocks of terms, all sources of the language in a block
    blocks = langs.select("lang", F.greatest(F.lit(1), F.ceil(F.col("n_sources") * shard_keys / BLOCK_CELLS)).cast("int").alias("n_blocks"))
    cells = (counted.join(groups.select("lang", "source", "no"), ["lang", "source"]).join(blocks, "lang")
             .select("lang", "shard", F.pmod("slot", "n_blocks").alias("block"), "slot", "no", "n"))
    heads = (groups.filter("v > 0").join(blocks, "lang").join(shards.select("lang", "shard"), "lang")
             .select("lang", "shard", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"),
                     F.lit(-1).alias("slot"), "no", (F.col("total") + 2 * F.col("v")).alias("n")))

    def pair_sums(table: pa.Table) -> pa.Table:
        slot, no, n = (table.column(c).to_numpy() for c in ("slot", "no", "n"))
        head = slot < 0
        whole = np.zeros(head.sum(), np.int64)
        whole[no[head]] = n[head]
        row, slots = np.unique(slot[~head], return_inverse=True)
        counts = np.full((len(row), len(whole)), 2, np.int64)
        counts[slots, no[~head]] += n[~head]
        p = shares(counts, whole[None, :])
        a, b, value = [], [], []
        for i in range(len(whole)):
            d, s = p - p[:, i:i + 1], p + p[:, i:i + 1]
            a.append(np.full(len(whole), i, np.int32))
            b.append(np.arange(len(whole), dtype=np.int32))
            value.append((d * d // s).sum(0))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(whole) ** 2, pa.string()),
                         "a": np.concatenate(a), "b": np.concatenate(b), "value": np.concatenate(value)})

    summed = (cells.unionByName(heads).groupBy("lang", "shard", "block")
              .applyInArrow(pair_sums, "lang string, a int, b int, value long")
              .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"))
    pairs = (groups.select("lang", "source", F.col("no").alias("a")).join(other, "lang").filter("a <> b")
             .join(summed, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(both).filter(F.col("rank") <= top_terms).unionByName(ranked(pairs))
