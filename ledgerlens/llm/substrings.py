"""Substring dedup: words covered by a repeated window of words are removed.

Rabin-Karp hashes of every window of ``window`` words decide: a window is a repeat if its word
sequence also starts earlier (smaller doc_id, or same document and earlier start). Counting
every window's hash as a row of its own would move many times the input, so windows are
counted in two steps that lose none:

1. Every window contains shorter grams; the one with the smallest hash is its anchor. Equal
   windows have equal anchors at equal places, and neighbouring windows share one, so a
   *run* (neighbouring windows of one anchor) stands for about seven windows. Runs are
   counted by anchor and by the hash of all their words, first inside a batch, then in
   hash buckets across batches. Of runs with equal words all but the earliest are repeats as
   a whole; a run whose anchor occurs once has no repeated window.
2. Only runs whose anchor also occurs in a different run are looked at window by window: their
   windows' hashes (128 bits) are counted in Spark, and all but the earliest start are repeats.

Overlapping and touching repeats merge into maximal removal intervals per document. A batch
sends at most one entry per anchor to a bucket, so a passage that a third of all documents
share does not gather in one task; in step 2 it is pre-aggregated and joined with skew
splitting.

Defined cases: null, empty or short texts have no window and stay as they are; null doc_id
orders last; rows of one doc_id count as that document, each with its own text, and equal
starts do not remove each other (so repeated rows stay alike); an empty table gives no rows;
an extra column called spans, n_words or n_removed is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, map_batches, ship_package, stored, text_hash
from .hashing import WINDOW_BASES, Prefix, Words, text_batches

BATCH_BYTES = 1_000_000
BUCKET_CHARS = 8_000_000
NO_ID = 2 ** 63 - 1
WORD_RUN = re.compile(WORD)
ENTRY_FIELDS = (("anchor", np.uint64), ("run", np.uint64), ("doc", np.int64), ("text_hash", np.int64),
                ("first", np.int32), ("more", np.int32), ("multi", np.int8))
SINGLE, REPEAT, COMPARE = 0, 1, 2


def window_runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: anchor hash, hash of the run's words, first
    window and last window (as word positions in the batch)."""
    starts = words.window_starts(window)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    n = len(words)
    at = np.arange(n - gram + 1)
    grams = Prefix(words.second, WINDOW_BASES[1]).stretch(at, at + gram)
    span = n - window + 1
    smallest, shift = grams[:span].copy(), np.zeros(span, np.int8)
    for s in range(1, window - gram + 1):
        other = grams[s:s + span]
        less = other < smallest
        smallest[less] = other[less]
        shift[less] = s
    anchor = starts + shift[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(anchor) != 0)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    whole = Prefix(words.hash, WINDOW_BASES[0]).stretch(first, last + window)
    return smallest[first], whole, first, last


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def sort_runs(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Entries sorted by anchor, run and place; which are repeats as a whole; and which have
    an anchor that also occurs with other words."""
    order = np.lexsort((e["first"], e["doc"], e["run"], e["anchor"]))
    e = {k: v[order] for k, v in e.items()}
    new_run, new_anchor = _groups(e["anchor"], e["run"], e["more"]), _groups(e["anchor"])
    run_no, anchor_no = np.cumsum(new_run) - 1, np.cumsum(new_anchor) - 1
    lead = np.flatnonzero(new_run)[run_no]
    repeat = (e["doc"] != e["doc"][lead]) | (e["first"] != e["first"][lead])
    n_anchors = anchor_no[-1] + 1 if len(anchor_no) else 0
    several = np.bincount(anchor_no[new_run], minlength=n_anchors) > 1
    several |= np.bincount(anchor_no, e["multi"], n_anchors) > 0
    return e, repeat, several[anchor_no] if len(anchor_no) else np.zeros(0, bool)


def _repeat_runs(docs: DataFrame, window: int, gram: int, n_buckets: int) -> DataFrame:
    """Rows (kind, doc, text_hash, first, more): runs that are repeats as a whole, and runs to
    compare window by window; ``more`` windows follow the first."""
    names = [name for name, _ in ENTRY_FIELDS]
    kinds = dict(ENTRY_FIELDS)

    def rows(kind: int, bucket: np.ndarray, e: dict[str, np.ndarray]):
        """One row per bucket, with its entries' fields as bytes."""
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        parts = [order] if not len(cut) else np.split(order, cut)
        parts = [p for p in parts if len(p)]
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(parts), pa.int32()), pa.array([int(bucket[p[0]]) for p in parts], pa.int32())]
            + [pa.array([e[k][p].astype(kinds[k]).tobytes() for p in parts], pa.binary()) for k in names],
            names=["kind", "bucket", *names])

    def find(batches):
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b, texts in text_batches(batch.column(2), BATCH_BYTES):
                words = Words(texts)
                anchor, run, first, last = window_runs(words, window, gram)
                if not len(anchor):
                    continue
                text = words.text[first]
                e = {"anchor": anchor, "run": run, "doc": ids[a:b][text], "text_hash": hashes[a:b][text],
                     "first": first - words.first[text], "more": last - first, "multi": np.zeros(len(anchor), np.int8)}
                e, repeat, several = sort_runs(e)

                def some(mask, **put):
                    return {k: v[mask] for k, v in e.items()} | put

                bucket = (e["anchor"] % np.uint64(n_buckets)).astype(np.int64)
                spread = (e["doc"] + e["first"]) % n_buckets
                if repeat.any():
                    yield rows(REPEAT, spread[repeat], some(repeat))
                compare = ~repeat & several
                if compare.any():
                    yield rows(COMPARE, spread[compare], some(compare))
                    # the batch knows these anchors are met several times; one entry tells the others
                    tell = compare.copy()
                    tell[compare] = _groups(e["anchor"][compare])
                    yield rows(SINGLE, bucket[tell], some(tell, multi=np.ones(tell.sum(), np.int8)))
                single = ~repeat & ~several
                if single.any():
                    yield rows(SINGLE, bucket[single], some(single))

    def decide(table: pa.Table) -> pa.Table:
        """One bucket: label its entries."""
        out = []
        kind = table.column("kind").to_numpy()
        for k in (SINGLE, REPEAT, COMPARE):
            part = table.filter(pa.array(kind == k))
            e = {name: np.frombuffer(b"".join(part.column(name).to_pylist()), dtype) for name, dtype in ENTRY_FIELDS}
            if not len(e["doc"]):
                continue
            if k == SINGLE:
                e, repeat, several = sort_runs(e)
                told = e["multi"] > 0  # its batch has already sent it for comparison
                label = np.where(repeat, REPEAT, np.where(several & ~told, COMPARE, SINGLE))
            else:
                label = np.full(len(e["doc"]), k)
            keep = label != SINGLE
            out.append(pa.table({"kind": pa.array(label[keep].astype(np.int32)), "doc": e["doc"][keep],
                                 "text_hash": e["text_hash"][keep], "first": e["first"][keep], "more": e["more"][keep]}))
        return pa.concat_tables(out) if out else pa.table(
            {"kind": pa.array([], pa.int32()), "doc": pa.array([], pa.int64()), "text_hash": pa.array([], pa.int64()),
             "first": pa.array([], pa.int32()), "more": pa.array([], pa.int32())})

    entries = map_batches(docs.select("_doc", "_hash", "text"), find,
                          "kind int, bucket int, " + ", ".join(f"{k} binary" for k in names))
    return entries.groupBy("bucket").applyInArrow(decide, "kind int, doc long, text_hash long, first int, more int")


def _repeat_windows(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """Rows (doc, text_hash, first): windows of the runs to compare that also start earlier."""
    wanted = runs.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("first", "more")).alias("runs"))
    picked = docs.join(wanted, (F.col("_doc") == F.col("doc")) & (F.col("_hash") == F.col("text_hash"))).select(
        "doc", "text_hash", "text", F.col("runs.first").alias("first"), F.col("runs.more").alias("more"))

    def hash_windows(batches):
        for batch in batches:
            for a, b, texts in text_batches(batch.column(2), BATCH_BYTES):
                words = Words(texts)
                sums = [Prefix(h, base) for h, base in zip((words.hash, words.second), WINDOW_BASES)]
                row, at = [], []
                for i in range(a, b):
                    first = np.array(batch.column(3)[i].as_py(), np.int64)
                    more = np.array(batch.column(4)[i].as_py(), np.int64)
                    pos = np.repeat(first, more + 1) + np.arange((more + 1).sum()) - np.repeat(
                        np.cumsum(more + 1) - more - 1, more + 1)
                    at.append(pos)
                    row.append(np.full(len(pos), i))
                row, at = np.concatenate(row), np.concatenate(at)
                start = words.first[row - a] + at
                h1, h2 = (s.stretch(start, start + window).view(np.int64) for s in sums)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)),
                     pa.array(h1), pa.array(h2)], names=["doc", "text_hash", "first", "h1", "h2"])

    windows = stored(map_batches(picked, hash_windows, "doc long, text_hash long, first int, h1 long, h2 long"))
    earliest = (windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "first")).alias("lead"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1").select("h1", "h2", "lead"))
    return (windows.join(earliest, ["h1", "h2"]).filter(F.struct("doc", "first") != F.col("lead"))
            .select("doc", "text_hash", "first"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (first, past the last) and the blanks after them."""
    starts = [m.start() for m in WORD_RUN.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:starts[a]])
        at = starts[b] if b < len(starts) else len(text)
    return "".join(out) + text[at:]


def dedup(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """``docs`` (doc_id, text and any others) with repeated passages cut from ``text``, and
    columns n_words, n_removed and spans (removed word intervals: first, past the last)."""
    ship_package(docs.sparkSession)
    docs = docs.drop("spans", "n_words", "n_removed")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n_buckets = max(16, chars // BUCKET_CHARS)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    named = text_hash()
    keyed = docs.select(doc.alias("_doc"), named.alias("_hash"), "text")
    runs = stored(_repeat_runs(keyed, window, gram, n_buckets))
    windows = _repeat_windows(keyed, runs.filter(F.col("kind") == COMPARE), window)
    # internal names that no input column should have
    repeats = (runs.filter(F.col("kind") == REPEAT).select("doc", "text_hash", "first", "more")
               .unionByName(windows.withColumn("more", F.lit(0)))
               .groupBy(F.col("doc").alias("__ll_doc"), F.col("text_hash").alias("__ll_hash"))
               .agg(F.collect_list(F.struct("first", "more")).alias("__ll_repeats")))
    joined = docs.withColumns({"__ll_doc": doc, "__ll_hash": named}).join(repeats, ["__ll_doc", "__ll_hash"], "left")
    joined = joined.select(*docs.columns, F.col("__ll_repeats.first").alias("__ll_first"),
                           F.col("__ll_repeats.more").alias("__ll_more"))
    columns = docs.columns
    text_at = columns.index("text")
    schema = T.StructType(list(docs.schema.fields) + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def cut(batches):
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            texts = batch.column(text_at).to_pylist()
            firsts, mores = (batch.column(len(columns) + k).to_pylist() for k in (0, 1))
            out, n_words, n_removed, all_spans = [], [], [], []
            for text, first, more in zip(texts, firsts, mores):
                spans = []
                if first:
                    edges = sorted((a, a + m + window) for a, m in zip(first, more))
                    spans = [list(edges[0])]
                    for a, b in edges[1:]:
                        if a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                out.append(cut_words(text, spans) if spans else text)
                n_words.append(len(text.encode().split()) if text else 0)
                n_removed.append(sum(b - a for a, b in spans))
                all_spans.append(spans)
            kept = [batch.column(i) if i != text_at else pa.array(out, pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(all_spans, pa.list_(pa.list_(pa.int32())))], names=[*columns, "n_words", "n_removed", "spans"])

    return map_batches(joined, cut, schema)
