"""Linking members of groups exactly, and connected components, as Spark jobs.

A group's members are linked by a test on their payloads; what is wanted are the connected
components. A task searches breadth first through one chunk of a group, comparing a found
member only with those not found yet, so near-duplicate groups cost about their size.
Members are searched by their number, so a component's edges go to its smallest member and the
edges of groups with the same members are the same ones.
Groups larger than a chunk are dealt over several, each of which also holds the group's pivots
(some tens of members picked by hash), which connects the chunks' large components. Then only
members outside a group's largest component are compared with all others, block by block;
with that every linked pair of a group is connected, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

PIVOTS = 32
EDGES = "a long, b long"


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, label): connected components of edges (a, b), label the smallest node.

    Alternating large-star and small-star steps; minima are pre-aggregated and joined back
    with skew splitting, so a hub does not gather in one task.
    """
    def only_stars(e: DataFrame) -> bool:
        """Every node points to one smaller node, which points nowhere itself."""
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("x"))
        per = ends.select("x.*").groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("is_end"))
        return not per.filter("n > 1 OR (n = 1 AND is_end = 0)").take(1)

    def star(e: DataFrame, out: list) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        both = e.join(least, "a").select(F.explode(F.array(*out)).alias("x"))
        return both.select("x.a", "x.b").filter("a > b").distinct()

    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not only_stars(e):
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(sym, [F.struct(F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a")).alias("a"),
                                    F.col("m").alias("b"))])
        e = stored(star(large, [F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                F.struct(F.col("a").alias("a"), F.col("m").alias("b"))]))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b"), F.col("b")).distinct())


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows sorted by the first ``n_keys`` columns) and where in the
    table each group starts, its end included."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = [table.column(i).to_numpy() for i in range(n_keys)]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.append(0, np.flatnonzero(new) + 1)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def search(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component of each of ``n`` members; ``near(i, rest)`` says which of ``rest`` link to i."""
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i] = i
        queue, rest = [i], np.flatnonzero(label < 0)
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            if hit.any():
                found = rest[hit]
                label[found] = i
                queue.extend(found.tolist())
                rest = rest[~hit]
    return label


class Linker:
    """A link test: ``load`` turns payloads into what ``near`` compares."""

    def load(self, payloads: list[bytes]):
        raise NotImplementedError

    def near(self, data, i: int, rest: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])


def link(members: DataFrame, payload: Callable[[DataFrame], DataFrame], linker: Linker, chunk_weight: int) -> DataFrame:
    """Edges (a, b) that connect all linked pairs within groups.

    ``members`` has (g, node, weight), ``payload`` adds a binary column ``payload`` to rows with
    a column node. Weights of a chunk add up to about ``chunk_weight``.
    """
    groups = (members.groupBy("g").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .withColumn("chunks", F.ceil(F.col("w") / chunk_weight).cast("int")).drop("w"))
    dealt = stored(members.join(groups, "g"))
    is_pivot = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")) < PIVOTS
    chunk = F.pmod(F.xxhash64("node", "g"), F.col("chunks")).cast("int")
    spread = dealt.select("g", F.explode(
        F.when(is_pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))).alias("chunk"), "node")

    def link_chunks(batches):
        for table, starts in sorted_groups(batches, 2):
            nodes = table.column("node").to_numpy()
            payloads = table.column("payload").to_pylist()
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                if e - s < 2:
                    continue
                data = linker.load(payloads[s:e])
                label = search(e - s, lambda i, rest: linker.near(data, i, rest))
                other = np.flatnonzero(label != np.arange(e - s))
                a += nodes[s + label[other]].tolist()
                b += nodes[s + other].tolist()
            if a:
                yield _edges(a, b)

    rows = payload(spread).select("g", "chunk", "node", "payload")
    first = stored(map_batches(rows.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "node"), link_chunks, EDGES).distinct())
    large = dealt.filter("chunks > 1")
    if not large.take(1):
        return first

    # groups of several chunks: members outside the largest component against all others
    label = connected(first)
    labelled = large.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    largest = (labelled.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("w"))
               .groupBy("g").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("w").alias("w"),
                                 F.max(F.struct("k", "w")).alias("top_w"))
               .select("g", F.col("top.label").alias("top"),
                       F.ceil((F.col("w") - F.col("top_w.w")) / chunk_weight).cast("int").alias("blocks")))
    labelled = labelled.join(largest, "g").filter("blocks > 0")
    block = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
    others = labelled.filter("label <> top").select(
        "g", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(0).alias("side"), "node", "label")
    everyone = labelled.select(
        "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"),
        F.lit(1).alias("side"), "node", "label")

    def link_blocks(batches):
        for table, starts in sorted_groups(batches, 3):
            nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
            labels = table.column("label").to_numpy()
            payloads = table.column("payload").to_pylist()
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                mine, theirs = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
                if not len(mine) or not len(theirs):
                    continue
                data = linker.load(payloads[s:e])
                own = labels[s:e]
                for i in mine:
                    rest = theirs[own[theirs] != own[i]]
                    if not len(rest):
                        continue
                    found = rest[linker.near(data, i, rest)]
                    _, one = np.unique(own[found], return_index=True)  # one edge connects two components
                    a += [nodes[s + i]] * len(one)
                    b += nodes[s + found[one]].tolist()
            if a:
                yield _edges(a, b)

    rows = payload(others.union(everyone)).select("g", "block", "chunk", "side", "node", "label", "payload")
    more = map_batches(rows.repartition("g", "block", "chunk").sortWithinPartitions("g", "block", "chunk"), link_blocks, EDGES)
    return stored(first.union(more).distinct())
