"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. One pass over whole texts: each document's set of distinct word shingles as 64-bit hashes,
   its size, a 128-bit fingerprint of the set and a signature of ``K`` minima. Documents with
   equal sets form a class; from here on classes are compared, never their copies.
2. Classes are posted under their (coordinate, value) pairs. Values that stand alone are
   dropped, and with them every class that cannot collide often enough. The match threshold
   is such that a pair of just the similarity asked for falls below it once in ``MISSES`` times.
   Prefix: of a class's m remaining postings, rarest first, only the first
   m - threshold + 1 are kept; two classes that collide at ``threshold`` coordinates share one.
3. Within each posting list, collisions are counted on signatures, skipping members that
   are connected already. What collides often enough makes candidate components.
4. Within each candidate component, links are confirmed on the full shingle sets.
5. Minima of a small set's few shingles go together, so signatures say less about it: sets of at
   most ``SMALL_SET`` shingles are also posted under their smallest shingles, of which two linked
   ones share one, and compared in full there; no link between them depends on a signature.

Long lists and large components are split into chunks without losing a link
(``components.link``). Nothing emits all pairs of a group.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing (their
component is their own doc_id); with fewer words than a shingle the whole sequence is one;
rows of one doc_id are separate texts under that id; null doc_id counts only where a
component has no other, then component_id is null and ``kept`` true (``drop_near_duplicates``
leaves one row of such a component too); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, ship_package, stored, text_hash
from .components import Linker, connected, link
from .hashing import WINDOW_BASES, Prefix, Words, mix, text_batches

K = 64
BATCH_BYTES = 1_000_000
LIST_CHUNK = 8192
MISSES = 50_000_000
SMALL_SET = 24
SET_CHUNK = 1_000_000
MULTIPLIERS = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def match_threshold(percent: int) -> int:
    """The most collisions of which a pair of the similarity asked for falls short at most once in
    ``MISSES`` times, by the exact binomial for independent coordinates (32 of 64 at 80 per cent)."""
    s, short, least = percent / 100, 0.0, 0
    while least < K:
        short += math.comb(K, least) * s ** least * (1 - s) ** (K - least)
        if short > 1 / MISSES:
            break
        least += 1
    return max(1, least)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; letters A-Z count as a-z."""
    words = Words([t.lower() for t in texts])
    prefix = Prefix(words.hash, WINDOW_BASES[0])
    n = np.where(words.counts > 0, np.maximum(words.counts - size + 1, 1), 0)
    first = np.repeat(words.first, n)
    start = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
    length = np.repeat(np.minimum(words.counts, size), n)
    hashes = prefix.stretch(start, start + length)
    out, at = [], 0
    for k in n.tolist():
        s = np.sort(hashes[at:at + k])
        out.append(s[np.append(True, s[1:] != s[:-1])] if k > 1 else s)
        at += k
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of ``K`` hashes over a set, as 32-bit values."""
    least = (s[:4096, None] * MULTIPLIERS).min(0)
    for a in range(4096, len(s), 4096):
        least = np.minimum(least, (s[a:a + 4096, None] * MULTIPLIERS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    spread = mix(s)
    return int(spread.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(spread + np.uint64(1))).view(np.int64))


class SignatureLinker(Linker):
    def __init__(self, threshold: int):
        self.threshold = threshold

    def load(self, payloads):
        return np.frombuffer(b"".join(payloads), np.uint16).reshape(len(payloads), K)

    def near(self, data, i, rest):
        return (data[rest] == data[i]).sum(1) >= self.threshold


class SetLinker(Linker):
    """Exact Jaccard similarity of shingle sets."""

    def __init__(self, percent: int):
        self.percent = percent

    def load(self, payloads):
        sizes = np.array([len(p) // 8 for p in payloads])
        values = np.frombuffer(b"".join(payloads), np.uint64)
        vocabulary, codes = np.unique(values, return_inverse=True)
        return {"sizes": sizes, "starts": np.cumsum(sizes) - sizes, "codes": codes, "mark": np.zeros(len(vocabulary), bool),
                "rest": None}

    def near(self, d, i, rest):
        own = d["codes"][d["starts"][i]:d["starts"][i] + d["sizes"][i]]
        # the concatenated sets of `rest` are kept until fewer than half are still asked for
        cached = d["rest"]
        if cached is None or len(rest) * 2 < len(cached[0]) or not np.isin(rest, cached[0], assume_unique=True).all():
            sizes = d["sizes"][rest]
            offsets = np.cumsum(sizes) - sizes
            at = np.repeat(d["starts"][rest] - offsets, sizes) + np.arange(sizes.sum())
            d["rest"] = cached = (rest, d["codes"][at], offsets)
        members, codes, offsets = cached
        d["mark"][own] = True
        shared = np.add.reduceat(d["mark"][codes].astype(np.int64), offsets)
        d["mark"][own] = False
        if len(members) != len(rest):
            shared = shared[np.searchsorted(members, rest)]
        union = d["sizes"][rest] + len(own) - shared
        return 100 * shared >= self.percent * union


def document_signatures(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, node, check, signature, small); node and check are the
    set's fingerprint, ``small`` is the set itself if it has at most ``SMALL_SET`` shingles."""
    def run(batches):
        for batch in batches:
            for a, b, texts in text_batches(batch.column(1), BATCH_BYTES):
                sets = shingle_sets(texts, size)
                sigs = np.concatenate([signature(s) if len(s) else np.zeros(K, np.uint32) for s in sets]).view(np.int32)
                prints = [fingerprint(s) if len(s) else (0, 0) for s in sets]
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * K)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(sigs)),
                     pa.array([s.tobytes() if 0 < len(s) <= SMALL_SET else None for s in sets], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "node", "check", "signature", "small"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash")), run,
                       "doc_id long, text_hash long, n_shingles long, node long, check long, signature array<int>, small binary")


def prefix_postings(classes: DataFrame, threshold: int) -> DataFrame:
    """Rows (g, node): posting lists of each class's rarest (coordinate, value) pairs."""
    # a (coordinate, value) pair as one number: narrow rows, as every class posts K of them
    pair = F.transform("signature", lambda v, c: F.shiftleft(c.cast("long"), 32).bitwiseOR(
        v.cast("long").bitwiseAND(F.lit(4294967295))))
    posted = classes.select("node", F.explode(pair).alias("g"))
    frequent = posted.groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1")
    kept = posted.join(frequent.hint("merge"), "g")
    # at most K postings per class
    ranked = kept.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("p")).filter(
        F.size("p") >= threshold)
    return ranked.select("node", F.explode(F.slice("p", 1, F.size("p") - (threshold - 1))).alias("p")).select("p.g", "node")


def small_links(classes: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Edges (a, b) that connect all linked pairs of small sets."""
    small = classes.filter("small IS NOT NULL").select("node", "n", "small")

    def post(batches):
        for batch in batches:
            nodes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # two linked sets share one of their so many smallest shingles
            heads = [np.frombuffer(p, np.int64)[:n - -(-percent * n // 100) + 1] for p, n in zip(batch.column(2).to_pylist(), sizes.tolist())]
            counts = [len(h) for h in heads]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)), pa.array(np.repeat(nodes, counts)),
                 pa.array(np.repeat(sizes, counts))], names=["g", "node", "weight"])

    postings = stored(map_batches(small, post, "g long, node long, weight long"))
    sets = small.select("node", F.col("small").alias("payload"))
    return link(postings, lambda rows: rows.join(sets.hint("merge"), "node"), SetLinker(percent), chunk)


def labelled(docs: DataFrame, size: int, percent: int, list_chunk: int = LIST_CHUNK,
             set_chunk: int = SET_CHUNK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash (which tells rows of one doc_id
    apart), n_shingles, label (a number of the row's component, null for an empty set) and
    component_id (the component's smallest doc_id)."""
    # the heavy joins are pinned to sort-merge, so that the plan (with its skew splitting) is the
    # same at every size and nothing is broadcast because it looks small
    ship_package(docs.sparkSession)
    threshold = match_threshold(percent)
    signed = stored(document_signatures(docs, size))
    classes = stored(signed.filter("n_shingles > 0").groupBy("node", "check").agg(
        F.min("doc_id").alias("first_doc"), F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("small").alias("small")))

    def add_signature(rows: DataFrame) -> DataFrame:
        return rows.join(short.hint("merge"), "node")

    def shorten(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().view(np.uint32).astype(np.uint16).reshape(-1, K)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())],
                                             names=["node", "payload"])

    postings = stored(prefix_postings(classes, threshold).withColumn("weight", F.lit(1)))
    # 16 bits of each value: collisions can only be overcounted, and links are confirmed later
    posted = postings.select("node").distinct()
    short = stored(map_batches(classes.select("node", "signature").join(posted, "node", "left_semi"), shorten,
                               "node long, payload binary"))
    candidates = connected(link(postings, add_signature, SignatureLinker(threshold), list_chunk))

    members = stored(candidates.join(classes, "node").select(F.col("label").alias("g"), "node", F.col("n").alias("weight"),
                                                             "first"))
    by_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))

    def full_sets(batches):
        for batch in batches:
            for a, b, texts in text_batches(batch.column(1), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())],
                    names=["node", "payload"])

    # only each class's first document, by its id and text; a repeated row of it is the same set again
    located = members.select("node", "first").hint("merge").join(
        by_id, F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))).select(
        "node", "text").dropDuplicates(["node"])
    sets = stored(map_batches(located, full_sets, "node long, payload binary"))
    links = link(members.select("g", "node", "weight"), lambda rows: rows.join(sets.hint("merge"), "node"),
                 SetLinker(percent), set_chunk)
    confirmed = connected(links.union(small_links(classes, percent, set_chunk)))
    by_class = classes.select("node", "check", "first_doc").join(confirmed, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    smallest = by_class.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    component = by_class.join(smallest, "label").select("node", "check", "label", "component_id")
    filled = F.col("n_shingles") > 0
    return (signed.drop("signature", "small").join(component, ["node", "check"], "left")
            .select("doc_id", "text_hash", "n_shingles", F.when(filled, F.col("label")).alias("label"),
                    F.when(filled, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, list_chunk: int = LIST_CHUNK,
                    set_chunk: int = SET_CHUNK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id
    connected by links of at least ``percent`` per cent Jaccard similarity) and kept."""
    return labelled(docs, size, percent, list_chunk, set_chunk).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id (null
    last), among rows of that doc_id the one of the smallest text hash. Rows without words are
    linked with nothing; of those with equal doc_id and text one stays."""
    alone = F.col("label").isNull()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("__ll_id"),
                     F.col("text_hash").alias("__ll_kept"))
    kept = (labelled(docs, size, percent)
            .groupBy("label", F.when(alone, F.col("doc_id")).alias("id"), F.when(alone, F.col("text_hash")).alias("hash"))
            .agg(F.min(order).alias("first")).select("first.__ll_id", "first.__ll_kept"))
    first = W.partitionBy("doc_id", "__ll_hash").orderBy(F.xxhash64(*docs.columns))
    named = docs.withColumn("__ll_hash", text_hash()).join(
        kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__ll_id")) & (F.col("__ll_hash") == F.col("__ll_kept")), "left_semi")
    return named.withColumn("__ll_no", F.row_number().over(first)).filter("__ll_no = 1").select(*docs.columns)
