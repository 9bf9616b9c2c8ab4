"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (byte classes, words, lines, repetition) are computed in
Arrow batches. Trees are fitted on a bounded sample of labelled rows (at most about
``sample_rows``, chosen by a hash of doc_id): features are binned by quantiles, every split is
found from per-bin gradient sums, and the fitted trees are flattened into arrays that score
a batch with one vectorised step per level.

Defined cases: null text counts as empty and is scored; null labels are not learned from,
labels other than 1 count as 0; with no label the score is 0.5, with labels of one class the
class's smoothed share; ties in a split go to the lower feature and bin; repeated rows are
kept (a repeated label is learned from once); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

SPACES = re.compile(r"[\x20\x09-\x0D]+")
_BYTE_CLASSES = {
    "symbol": b"#*$%&|<>", "stop": b".!?", "exclaim": b"!", "comma": b",;:", "bar": b"|", "dash": b"-_=~",
    "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)),
    "quote": b"\"'`", "bracket": b"()[]{}", "slash": b"/\\@", "control": bytes([*range(9), *range(14, 32), 127]),
}
_CLASS_INDEX = {k: np.frombuffer(v, np.uint8).astype(int) for k, v in _BYTE_CLASSES.items()}
FEATURES = [*[f"share_{k}" for k in _BYTE_CLASSES], "share_wide", "log_chars", "log_words", "word_length",
            "short_words", "long_words", "distinct_words", "top_word", "same_as_before", "repeated_pairs",
            "repeated_windows", "log_lines", "words_per_line", "dup_lines", "max_word", "stops_per_word"]


def text_statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    per_byte = np.bincount(raw, minlength=256)
    n_bytes = max(1, len(raw) - int(per_byte[[9, 10, 11, 12, 13, 32]].sum()))
    words = text.split() if text.isascii() else [w for w in SPACES.split(text) if w]
    n = len(words)
    some = max(1, n)
    by_word = Counter(words)
    pairs = max(1, n - 1)
    fives = max(1, n - 4)
    lengths = [len(w) for w in by_word]
    counts = list(by_word.values())
    lengths, counts = np.array(lengths or [0]), np.array(counts or [0])
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    n_lines = max(1, len(lines))
    return [
        *[per_byte[i].sum() / n_bytes for i in _CLASS_INDEX.values()], per_byte[128:].sum() / n_bytes,
        np.log1p(len(text)), np.log1p(n), (lengths * counts).sum() / some,
        counts[lengths <= 2].sum() / some, counts[lengths >= 12].sum() / some, len(by_word) / some,
        counts.max() / some, sum(map(eq, words, words[1:])) / pairs,
        1 - len(set(zip(words, words[1:]))) / pairs if n > 1 else 0.0,
        1 - len(set(zip(words, words[2:], words[4:]))) / fives if n > 4 else 0.0,
        np.log1p(len(lines)), n / n_lines, 1 - len(set(lines)) / n_lines if lines else 0.0, lengths.max(),
        per_byte[_CLASS_INDEX["stop"]].sum() / some]


class Trees:
    """Boosted trees as flat arrays: node i of tree t tests ``feature[t, i] <= threshold[t, i]``
    and goes to ``left`` or ``left + 1``; a leaf points to itself."""

    def __init__(self, base: float, depth: int, feature, threshold, left, value):
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.left, self.value = feature, threshold, left, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        out = np.empty(len(x))
        tree = np.arange(len(self.feature))[None, :]
        for a in range(0, len(x), 4096):
            part = x[a:a + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int32)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[tree, node]
                right = part[rows, np.maximum(f, 0)] > self.threshold[tree, node]
                node = np.where(f < 0, node, self.left[tree, node] + right)
            out[a:a + 4096] = self.base + self.value[tree, node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.12,
              bins: int = 64, min_rows: int = 12, l2: float = 2.0) -> Trees:
    """Log-loss boosting with histogram splits."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        empty = np.zeros((0, 1))
        return Trees(base, 0, empty.astype(int), empty, empty.astype(int), empty)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], 1)
    flat = binned + np.arange(k) * bins
    size = 2 ** (depth + 1) - 1
    feature = np.full((n_trees, size), -1, np.int32)
    threshold = np.zeros((n_trees, size))
    left = np.zeros((n_trees, size), np.int32)
    value = np.zeros((n_trees, size))
    score = np.full(n, base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        todo, used = [(0, np.arange(n), 0)], 1
        while todo:
            node, rows, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[t, node] = rate * g / (h + l2)
            best = None
            if level < depth and len(rows) >= 2 * min_rows:
                at = flat[rows].ravel()
                def per_bin(v):
                    return np.bincount(at, np.repeat(v, k), k * bins).reshape(k, bins).cumsum(1)
                gl, hl = per_bin(grad[rows]), per_bin(hess[rows])
                nl = np.bincount(at, minlength=k * bins).reshape(k, bins).cumsum(1)
                gain = gl ** 2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g ** 2 / (h + l2)
                gain[(nl < min_rows) | (len(rows) - nl < min_rows)] = -1
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    best = j, b
            if best is None:
                score[rows] += value[t, node]
                continue
            j, b = best
            feature[t, node], threshold[t, node], left[t, node] = j, edges[j][b], used
            goes_left = binned[rows, j] <= b
            todo += [(used, rows[goes_left], level + 1), (used + 1, rows[~goes_left], level + 1)]
            used += 2
    return Trees(base, depth, feature, threshold, left, value)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and an array ``stats`` for documents with a column text."""
    docs = docs.select(*keep, "text")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            rows = np.array([text_statistics(t or "") for t in batch.column(len(keep)).to_pylist()], float)
            rows = rows.reshape(batch.num_rows, len(FEATURES))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))],
                names=[*keep, "stats"])

    return map_batches(docs, run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, **params) -> Trees:
    """Trees from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), on at most about
    ``sample_rows`` labelled rows: those whose hash of doc_id falls under a share of all."""
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").distinct()
    total = known.count()
    limit = 1_000_000_000
    share = min(limit, sample_rows * limit // max(1, total))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(limit)) < share)
    # the chosen (doc_id, quality) pairs are bounded by sample_rows, and so are the rows that come
    # back: of several rows of one doc_id the one with the smallest statistics stands for all
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "quality"])
    got = rows.groupBy("doc_id", "quality").agg(F.min("stats").alias("stats")).toPandas()
    if got.empty:
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0), **params)
    # the order of rows must not matter for sums of floats
    got = got.sort_values(["doc_id", "quality"])
    return fit_trees(np.stack(got["stats"].to_numpy()), (got["quality"] == 1).to_numpy(float), **params)


def score(docs: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (which may include text) and ``quality_score`` (0 to 1)."""
    keep = [c for c in keep if c != "quality_score"]
    docs = docs.select(*keep, F.col("text").alias("__ll_text"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("quality_score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            rows = [text_statistics(t or "") for t in batch.column(len(keep)).to_pylist()]
            x = np.array(rows, float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))]
                                             + [pa.array(held.value.score(x))], names=[*keep, "quality_score"])

    return map_batches(docs, run, schema)
