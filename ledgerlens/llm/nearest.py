"""Nearest neighbours by largest inner product, as a block matrix join.

Vectors are packed into blocks, as they are; whoever reads a block makes an int8 copy of it:
each vector has its own scale, and the norm of what rounding lost is kept. Blocks of candidates
meet blocks of queries; a tile's products are whole numbers (exact in float32), and with the
rounding norms each gives an upper and a lower bound of the true inner product
(Cauchy-Schwarz). Only pairs whose upper bound reaches a query's k-th best so far are
recomputed in double, and go to the query's heap; heaps of the lanes that searched different
candidates are merged at the end. Bounds are exact, so the result is exact.

Candidate blocks are dealt over lanes of ``LANE_BLOCKS`` blocks on average. A query block is
sent once to each lane, a candidate block once for each query block, so candidates dominate
what is shuffled: their own bytes times the number of query blocks. A task keeps one query
block, one candidate block, a tile and ``k`` rows per query; a block holds at most
``BLOCK_BYTES`` of vectors, whatever their length.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and
rows without vec_id, take no part; vectors with a component beyond ``PLAIN`` or without one
above its inverse take part by their exact products alone (sums that overflow are infinite; one
that is no number, infinity less infinity, ranks last); vectors of different lengths are never
compared; rows of one vec_id are all candidates of others but never of that id, and as queries
count once (the smallest vector); ties go to the smaller vec_id; with fewer than ``k``
candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, map_batches, stored

BLOCK_SCHEMA = "dim int, n int, ids binary, vectors binary"
BLOCK_BYTES = 16 << 20
LANE_BLOCKS = 4
PLAIN = 1e100  # largest component of a vector whose norms and products are far from overflow
NO_ID = np.iinfo(np.int64).max


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norm of the rounding loss and norm of each row of ``x`` (double)."""
    scale = np.abs(x).max(1) / 127.0
    codes = np.rint(x / scale[:, None])
    lost = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, lost, np.linalg.norm(x, axis=1)


def pack(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of at most ``block_rows`` usable vectors of one length, from (vec_id, embedding);
    single precision stays single."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64

    def flush(dim, ids, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32())]
            + [pa.array([b.tobytes()], pa.binary()) for b in (np.array(ids, np.int64), np.array(rows, kind))],
            names=["dim", "n", "ids", "vectors"])

    def run(batches):
        open_blocks: dict[int, tuple[list, list]] = {}
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float64())
            holes = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
            values = flat.to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                a, b = ends[i] - sizes[i], ends[i]
                v = values[a:b]
                if (vec_id is None or a == b or not np.isfinite(v).all() or not v.any()
                        or (holes is not None and holes[a:b].any())):
                    continue
                ids, rows = open_blocks.setdefault(len(v), ([], []))
                ids.append(vec_id)
                rows.append(v.astype(kind))
                if len(ids) >= min(block_rows, max(1, BLOCK_BYTES // (len(v) * np.dtype(kind).itemsize))):
                    yield flush(len(v), *open_blocks.pop(len(v)))
        for dim, (ids, rows) in open_blocks.items():
            yield flush(dim, ids, rows)

    return map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, BLOCK_SCHEMA)


class Block:
    """A block's vectors in double with their int8 copy; ``wild`` ones have no bounds."""

    def __init__(self, dim: int, n: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        kind = np.float32 if len(vectors) == 4 * n * dim else np.float64
        self.x = np.frombuffer(vectors, kind).reshape(n, dim).astype(np.float64)
        size = np.abs(self.x).max(1)
        self.wild = (size > PLAIN) | (size < 1 / PLAIN)
        self.codes, self.scales, self.lost, self.norms = quantise(
            np.where(self.wild[:, None], 1.0, self.x) if self.wild.any() else self.x)


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows: sums of up to 1024 terms are whole numbers below 2 ** 24, exact
    in float32, so longer rows are summed in stretches."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i:i + 1024].astype(np.float32) @ b[:, i:i + 1024].astype(np.float32).T
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double, each summed from the first component to the last, so
    that equal vectors get equal scores whatever batch they stand in."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class Heaps:
    """The k best (score, smaller id first) candidates of every query of a block."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.best = np.full((len(block.ids), k), -np.inf)
        self.found = np.full((len(block.ids), k), NO_ID)

    def offer(self, c: Block) -> None:
        b = self.block
        for a in range(0, len(b.ids), 512):
            q = slice(a, min(a + 512, len(b.ids)))
            near = integer_products(b.codes[q], c.codes) * b.scales[q][:, None] * c.scales
            coded_norm = b.norms[q] + b.lost[q]
            error = b.lost[q][:, None] * c.norms + coded_norm[:, None] * c.lost
            error += 1e-9 * b.norms[q][:, None] * c.norms  # double rounding, amply
            error[b.wild[q]] = np.inf
            error[:, c.wild] = np.inf
            other = b.ids[q][:, None] != c.ids
            lower = np.where(other, near - error, -np.inf)
            floor = self.best[q][:, -1]
            floor = np.where(np.isnan(floor), -np.inf, floor)
            if len(c.ids) > self.k:
                floor = np.maximum(floor, np.partition(lower, -self.k, axis=1)[:, -self.k])
            qi, ci = np.nonzero(other & (near + error >= floor[:, None]))
            if not len(qi):
                continue
            exact = np.empty(len(qi))
            for s in range(0, len(qi), 50_000):
                e = slice(s, s + 50_000)
                exact[e] = inner_products(b.x[a + qi[e]], c.x[ci[e]])
            held = np.repeat(np.arange(q.stop - a), self.k)
            rows = np.concatenate([held, qi])
            score = np.concatenate([self.best[q].ravel(), exact])
            found = np.concatenate([self.found[q].ravel(), c.ids[ci]])
            empty = np.concatenate([self.found[q].ravel() == NO_ID, np.zeros(len(qi), bool)])
            # a score that is no number comes last, before empty places
            order = np.lexsort((found, -score, np.isnan(score), empty, rows))
            rows = rows[order]
            first = np.searchsorted(rows, np.arange(q.stop - a))
            keep = order[(first[:, None] + np.arange(self.k))]
            self.best[q], self.found[q] = score[keep], found[keep]

    def batch(self) -> pa.RecordBatch:
        real = self.found != NO_ID
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.block.ids, real.sum(1))), pa.array(self.found[real]), pa.array(self.best[real])],
            names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = 4096,
           candidate_block: int = 2048) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest of every query, nearest first."""
    usable = (F.col("embedding").isNotNull() & (F.size("embedding") > 0)
              & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    vectors = vectors.select("vec_id", "embedding")
    queries = (vectors.filter(is_query & usable).groupBy("vec_id")
               .agg(F.min("embedding").alias("embedding")))
    q = stored(pack(queries, query_block).withColumn("query_block", F.monotonically_increasing_id()))
    lanes = max(1, -(-vectors.count() // (candidate_block * LANE_BLOCKS)))
    c = pack(vectors, candidate_block).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
    # a query block opens each lane, then every candidate block of its length follows
    fields = ["query_block", "lane", "is_query", "dim", "n", "ids", "vectors"]
    opens = q.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    met = c.join(broadcast_if_small(q.select("dim", "query_block"), 1_000_000), "dim")
    both = opens.withColumn("is_query", F.lit(True)).select(fields).union(
        met.withColumn("is_query", F.lit(False)).select(fields))
    parts = min(20_000, 4 * lanes * max(1, q.count()))
    dealt = both.repartition(parts, "query_block", "lane").sortWithinPartitions(
        "query_block", "lane", F.desc("is_query"))

    def run(batches):
        heaps = None
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                block = Block(*(batch.column(at[name])[i].as_py() for name in ("dim", "n", "ids", "vectors")))
                if batch.column(at["is_query"])[i].as_py():
                    if heaps is not None:
                        yield heaps.batch()
                    heaps = Heaps(block, k)
                else:
                    heaps.offer(block)
        if heaps is not None:
            yield heaps.batch()

    found = map_batches(dealt, run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
