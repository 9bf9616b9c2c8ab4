"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two sets of sizes n and m are linked from ``percent`` per cent Jaccard similarity on if they
share T = ceil(percent * (n + m) / (100 + percent)) shingles: each occurs in T of the other's
inverted lists. Three steps, none of which loses a link:

1. One pass over whole texts: set size, a 128-bit fingerprint of the set (documents of equal
   sets are one class from here on), and the set's prefix: its smallest shingle hashes, so many
   that two linked sets share ``spare`` of them at least. Also a parity bitmap of the set, two to
   four bits a shingle: sets differ in as many shingles at least as bitmaps differ in bits.
2. The corpus' inverted lists over prefixes. Lists of one class are dropped, and classes that
   keep too few. Of a class's lists the longest, ``spare`` - 1 of a linked partner at least, are
   set aside: a partner must be met in a shorter one. Lists of the same members are one group.
   Within groups members whose sizes or bitmaps exclude a link are told apart, the others make
   candidate components.
3. Within a candidate component, full sets: every list of a chunk is inverted, and for each
   member searched, lists are divided; the short ones are merged over a heap that skips what
   cannot occur often enough, survivors are probed in the long ones by binary search, and those
   that reach T are linked.

Large groups and components are dealt over chunks without losing a link (``components.link``);
no pairs of a group are emitted but links that connect it.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing (their
component is their own doc_id); with fewer words than a shingle the whole sequence is one;
rows of one doc_id are separate texts under that id; null doc_id counts only where a component
has no other, then component_id is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship_package, stored, text_hash
from .components import Linker, connected, link
from .hashing import WINDOW_BASES, Prefix, Words, mix, text_batches

BATCH_BYTES = 1_000_000
LIST_CHUNK = 8192
SET_CHUNK = 1_000_000
SPARE_SHARE = 32
LENGTH_COST = 0.02
KNOWN_SETS = 100_000


def needed(n, m, percent: int):
    """Shingles that linked sets of sizes n and m share at least."""
    return -(-percent * (n + m) // (100 + percent))


def smallest_partner(n, percent: int):
    return -(-percent * n // 100)


def spare(n, percent: int):
    """How many prefix shingles a set of n shares with any linked set at least."""
    return 1 + smallest_partner(n, percent) // SPARE_SHARE


def prefix_length(n, percent: int):
    """Two linked sets share ``spare`` of so many smallest shingles of each: the larger one's
    smallest n - needed + spare hold that many of the common ones."""
    return np.minimum(n, n - smallest_partner(n, percent) + 1 + n // SPARE_SHARE)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; letters A-Z count as a-z."""
    words = Words([t.lower() for t in texts])
    sums = Prefix(words.hash, WINDOW_BASES[0])
    n = np.where(words.counts > 0, np.maximum(words.counts - size + 1, 1), 0)
    ends = np.cumsum(n)
    start = np.repeat(words.first - (ends - n), n) + np.arange(n.sum())
    hashes = sums.stretch(start, start + np.repeat(np.minimum(words.counts, size), n))
    return [np.unique(hashes[e - k:e]) for k, e in zip(n.tolist(), ends.tolist())]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by hash: a power of two of bits, two a shingle at least."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(bitmap: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bitmaps (rows) of a smaller power of two: parities of the same shingles modulo less."""
    return np.bitwise_xor.reduce(bitmap.reshape(*bitmap.shape[:-1], -1, n_bytes), axis=-2)


class BitmapFilter(Linker):
    """Excludes pairs whose sizes or parity bitmaps rule a link out."""

    def __init__(self, percent: int):
        self.percent = percent

    def load(self, payloads):
        sizes = np.array([int.from_bytes(p[:8], "little") for p in payloads])
        maps = [np.frombuffer(p, np.uint8, offset=8) for p in payloads]
        by_length: dict[int, list[int]] = {}
        for i, m in enumerate(maps):
            by_length.setdefault(len(m), []).append(i)
        place = np.empty(len(maps), np.int64)
        stacked = {}
        for k, members in by_length.items():
            place[members] = np.arange(len(members))
            stacked[k] = np.stack([maps[i] for i in members])
        return {"sizes": sizes, "length": np.array([len(m) for m in maps]), "place": place, "stacked": stacked, "maps": maps}

    def near(self, d, i, rest):
        n, own = d["sizes"][i], d["maps"][i]
        sizes, lengths = d["sizes"][rest], d["length"][rest]
        # sets that share what is needed differ in no more shingles than this
        most = n + sizes - 2 * needed(n, sizes, self.percent)
        out = (100 * np.minimum(n, sizes) >= self.percent * np.maximum(n, sizes))
        for k in np.unique(lengths[out]):
            mine = np.flatnonzero(out & (lengths == k))
            bits = min(k, len(own))
            theirs = d["stacked"][k][d["place"][rest[mine]]]
            theirs = folded(theirs, bits) if k > bits else theirs
            self_map = folded(own, bits) if len(own) > bits else own
            out[mine] = np.bitwise_count(theirs ^ self_map).sum(1, dtype=np.int64) <= most[mine]
        return out


def merge_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Members in at least ``least`` of the sorted ``lists``, with how many. The heads lie on a
    heap; what cannot occur often enough is skipped by binary search."""
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at, found = [0] * len(lists), {}
    while len(heap) >= least:
        head, popped = heap[0][0], []
        while heap and heap[0][0] == head:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            found[head] = len(popped)
            target = head + 1
        else:
            # a member below the next head left is in fewer than ``least`` lists
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for k in popped:
            x = lists[k]
            at[k] = place = bisect_left(x, target, at[k])
            if place < len(x):
                heapq.heappush(heap, (x[place], k))
    return found


class OccurrenceLinker(Linker):
    """Exact Jaccard similarity of shingle sets by T-occurrence search on inverted lists."""

    def __init__(self, percent: int):
        self.percent = percent

    def load(self, payloads):
        sizes = np.array([len(p) // 8 for p in payloads])
        values = np.frombuffer(b"".join(payloads), np.uint64)
        payloads.clear()
        _, codes = np.unique(values, return_inverse=True)
        codes = codes.astype(np.int32)
        d = {"sizes": sizes, "starts": np.cumsum(sizes) - sizes, "codes": codes}
        self._invert(d, np.arange(len(sizes)))
        return d

    @staticmethod
    def _invert(d, members):
        """Inverted lists of ``members`` (ascending): all lists in one array, by shingle."""
        sizes = d["sizes"][members]
        at = np.repeat(d["starts"][members] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        codes = d["codes"][at]
        order = np.argsort(codes, kind="stable")
        d["postings"] = np.repeat(members, sizes)[order]
        d["ends"] = np.cumsum(np.bincount(codes, minlength=int(d["codes"].max(initial=-1)) + 1))
        d["indexed"] = np.zeros(len(d["sizes"]), bool)
        d["indexed"][members] = True

    def near(self, d, i, rest):
        if not d["indexed"][rest].all():
            self._invert(d, np.arange(len(d["sizes"])))
        elif 2 * len(rest) < d["indexed"].sum():
            self._invert(d, rest)  # lists without the members that were found
        n = int(d["sizes"][i])
        own = d["codes"][d["starts"][i]:d["starts"][i] + n]
        begin, end = np.where(own > 0, d["ends"][own - 1], 0), d["ends"][own]
        least = int(needed(n, smallest_partner(n, self.percent), self.percent))
        filled = np.flatnonzero(end > begin)
        out = np.zeros(len(rest), bool)
        if len(filled) < least:
            return out
        order = filled[np.argsort((begin - end)[filled], kind="stable")]  # longest first
        longest = int(end[order[0]] - begin[order[0]])
        n_long = min(least - 1, int(least / (LENGTH_COST * np.log2(longest + 1) + 1)))
        long, short = order[:n_long], order[n_long:]
        postings = d["postings"]
        counted = merge_skip([postings[b:e].tolist() for b, e in zip(begin[short].tolist(), end[short].tolist())], least - n_long)
        members = np.fromiter(counted.keys(), np.int64, len(counted))
        counts = np.fromiter(counted.values(), np.int64, len(counted))
        sizes = d["sizes"][members]
        wanted = needed(n, sizes, self.percent)
        open_ = (counts + n_long >= wanted) & (100 * np.minimum(n, sizes) >= self.percent * np.maximum(n, sizes))
        members, counts, wanted = members[open_], counts[open_], wanted[open_]
        for k in range(n_long):
            if not len(members):
                break
            x = postings[begin[long[k]]:end[long[k]]]
            at = np.searchsorted(x, members)
            counts = counts + ((at < len(x)) & (x[np.minimum(at, len(x) - 1)] == members))
            if k % 16 == 15:  # those that the lists left cannot lift high enough
                can = counts + (n_long - 1 - k) >= wanted
                members, counts, wanted = members[can], counts[can], wanted[can]
        linked = members[counts >= wanted]
        place = np.searchsorted(rest, linked)
        place = place[(place < len(rest)) & (rest[np.minimum(place, len(rest) - 1)] == linked)]
        out[place] = True
        return out


def document_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, node, check, prefix, bitmap); node and check are the
    set's fingerprint. A set that the same task has met before has no prefix and no bitmap."""
    def run(batches):
        known: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, texts in text_batches(batch.column(1), BATCH_BYTES):
                sets = shingle_sets(texts, size)
                prints = [fingerprint(s) if len(s) else (0, 0) for s in sets]
                prefixes, maps = [], []
                for s, p in zip(sets, prints):
                    new = len(s) > 0 and p not in known
                    if new:
                        known.add(p)
                        known = known if len(known) < KNOWN_SETS else set()
                    prefixes.append(s[:int(prefix_length(len(s), percent))] if new else s[:0])
                    maps.append(parity_bitmap(s).tobytes() if new else None)
                offsets = np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32)
                flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(maps, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "node", "check", "prefix", "bitmap"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash")), run,
                       "doc_id long, text_hash long, n_shingles long, node long, check long, prefix array<long>, bitmap binary")


def short_lists(signed: DataFrame, percent: int) -> DataFrame:
    """Rows (g, node): members of the corpus' inverted lists that are short for them."""
    posted = signed.filter("bitmap IS NOT NULL").select("node", F.col("n_shingles").cast("int").alias("n"), F.explode("prefix").alias("s"))
    often = posted.groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1")
    met = posted.join(often.hint("merge"), "s")
    # what a list's members are, repeated members counted once; equal lists become one group
    spread = F.xxhash64("node")
    lists = met.groupBy("s").agg(F.min(spread).alias("lo"), F.max(spread).alias("hi"), F.min(F.xxhash64("node", F.lit(1))).alias("lo2"),
                                 F.max(F.xxhash64("node", F.lit(1))).alias("hi2")).filter("lo < hi")
    group = F.xxhash64("lo", "hi", "lo2", "hi2")
    kept = met.join(lists.select("s", group.alias("g")).hint("merge"), "s").select("node", "n", "df", "g", "s")
    # a class's own lists, at most its prefix; a class met in several tasks has each once
    ranked = kept.groupBy("node", "n").agg(F.sort_array(F.collect_set(F.struct("df", "s", "g"))).alias("p"))
    aside = F.expr(f"int(({percent} * n + 99) div 100 div {SPARE_SHARE})")
    return (ranked.filter(F.size("p") > aside)
            .select("node", F.explode(F.array_distinct(F.transform(F.slice("p", 1, F.size("p") - aside), lambda x: x["g"]))).alias("g"))
            .select("g", "node"))


def join(docs: DataFrame, size: int = 5, percent: int = 80, list_chunk: int = LIST_CHUNK,
         set_chunk: int = SET_CHUNK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id
    connected by links of at least ``percent`` per cent Jaccard similarity of n-gram sets."""
    ship_package(docs.sparkSession)
    signed = stored(document_sets(docs, size, percent))
    classes = stored(signed.filter("n_shingles > 0").groupBy("node", "check").agg(
        F.min("doc_id").alias("least_doc"), F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.first("n_shingles").alias("n")))
    postings = stored(short_lists(signed, percent).withColumn("weight", F.lit(1)))
    maps = (signed.filter("bitmap IS NOT NULL").select("node", "n_shingles", "bitmap")
            .join(postings.select("node").distinct().hint("merge"), "node", "left_semi"))

    def with_size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n.to_bytes(8, "little") + m for n, m in zip(
                    batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.binary())], names=["node", "payload"])

    maps = stored(map_batches(maps.dropDuplicates(["node"]), with_size, "node long, payload binary"))
    candidates = connected(link(postings, lambda rows: rows.join(maps.hint("merge"), "node"), BitmapFilter(percent), list_chunk))

    members = stored(candidates.join(classes, "node").select(
        F.col("label").alias("g"), "node", F.col("n").alias("weight"), "first"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    located = members.select("node", "first").hint("merge").join(
        texts, F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))).select("node", "text")

    def full_sets(batches):
        for batch in batches:
            for a, b, raw in text_batches(batch.column(1), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(raw, size)], pa.binary())],
                    names=["node", "payload"])

    # a repeated row of a class's first document is the same set again
    sets = stored(map_batches(located.dropDuplicates(["node"]), full_sets, "node long, payload binary"))
    linked = connected(link(members.select("g", "node", "weight"), lambda rows: rows.join(sets.hint("merge"), "node"),
                            OccurrenceLinker(percent), set_chunk))
    by_class = classes.select("node", "check", "least_doc").join(linked, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    smallest = by_class.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    component = by_class.join(smallest, "label").select("node", "check", "component_id")
    return (signed.select("doc_id", "n_shingles", "node", "check").join(component, ["node", "check"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
