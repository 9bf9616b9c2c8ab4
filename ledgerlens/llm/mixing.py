"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes (words) per document, totals per source, target words per source: sources share
   the total by weight; a target stops at ``max_repeats`` times its source's size and the
   excess is shared again by weight (water filling, one sorted pass).
2. Documents are cut into blocks of at most ``block_words`` words (``None``: a document is
   one block). A source's blocks are put in a random order by hash; whole passes plus a
   partial pass over that order come to the target, to within half a block. That fixes the
   exact number of blocks (quota) of every source.
3. A binary tree deals the quotas to output shards: every node gives its left child half of
   its slots, and how many of each source is a multivariate-hypergeometric draw (source by
   source, by inversion from the mode). Quotas stay exact at every level.
4. Each shard draws its own disjoint run of each source's ordered blocks and shuffles them
   locally. All draws are hashes of the seed, so reruns agree.

Everything is DataFrame and SQL functions. A hot source is split into hash buckets before
any ordering, so no task orders a whole source.

Defined cases: null or blank text has size 0 and is never taken; null source is a source of
its own and comes last; repeated rows are separate documents; an empty table gives empty
results; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, text_hash, words

BUCKET_BLOCKS = 4096


class Mix(NamedTuple):
    """sizes: one row per document with its source's size and target; draws: one row per
    drawn block with its shard and position; shard_quotas: blocks per shard and source."""

    sizes: DataFrame
    draws: DataFrame
    shard_quotas: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int,
                   n_blocks: Column) -> DataFrame:
    """Per source: id in code-point order (null last), size, blocks, weight and target."""
    totals = sizes.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"),
        F.sum(n_blocks).cast("long").alias("source_blocks"))
    # one row per source from here on: a table of source names, not of data
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                          (F.col("sid") % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    capped = (F.col("cap") * F.col("w_onward")
              <= F.col("weight") * (F.col("total") - F.col("cap_before")))
    totals = (totals
              .withColumn("total", total.cast("double"))
              .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("w_onward", F.sum("weight").over(onward))
              .withColumn("capped", capped))
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("weight") * (F.col("total") - used) / free))
    return totals.withColumn("target", target).select(
        "sid", "source", "source_size", "source_blocks", "target")


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``let name = value in body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ln_factorial(x: str) -> str:
    """SQL for ln(x!) by Stirling's series at x + 8, stepped down to x."""
    series = ("(z + 0.5D) * ln(z) - z + 0.9189385332046727D + 1 / (12 * z)"
              " - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)")
    steps = " * ".join(f"(z - {k}D)" for k in range(8))
    return "(" + _bind(f"double({x}) + 8", "z", f"{series} - ln({steps})") + ")"


def hypergeometric_sql(n_all: str, n_good: str, n_draw: str, u: str) -> str:
    """SQL for a hypergeometric draw: how many of ``n_draw`` items, drawn without return
    from ``n_all`` of which ``n_good`` are marked, are marked. ``u`` is uniform in (0, 1).

    Inversion outwards from the mode: probabilities of neighbours follow by ratios, so the
    steps are about eight standard deviations at most, whatever the sizes.
    """
    lf = _ln_factorial
    up = ("if(s.a >= p.hi, 0D, s.pa * (p.g - s.a) * (p.d - s.a)"
          " / ((s.a + 1) * (p.n - p.g - p.d + s.a + 1)))")
    down = ("if(s.b <= p.lo, 0D, s.pb * s.b * (p.n - p.g - p.d + s.b)"
            " / ((p.g - s.b + 1) * (p.d - s.b + 1)))")

    def state(u_, x, a, pa, b, pb, done):
        return (f"named_struct('u', {u_}, 'x', {x}, 'a', {a}, 'pa', {pa},"
                f" 'b', {b}, 'pb', {pb}, 'done', {done})")

    step = _bind(f"named_struct('up', {up}, 'down', {down})", "q",
                 "CASE WHEN s.u < q.up THEN "
                 + state("s.u", "s.a + 1", "s.a", "s.pa", "s.b", "s.pb", "true")
                 + " WHEN s.u < q.up + q.down THEN "
                 + state("s.u", "s.b - 1", "s.a", "s.pa", "s.b", "s.pb", "true")
                 + " ELSE "
                 + state("s.u - q.up - q.down", "s.x", "s.a + 1", "q.up", "s.b - 1", "q.down", "false")
                 + " END")
    p0 = (f"exp({lf('p.g')} - {lf('p.m')} - {lf('p.g - p.m')} + {lf('p.n - p.g')}"
          f" - {lf('p.d - p.m')} - {lf('p.n - p.g - p.d + p.m')}"
          f" - {lf('p.n')} + {lf('p.d')} + {lf('p.n - p.d')})")
    start = _bind(p0, "p0", state("p.u - p0", "p.m", "p.m", "p0", "p.m", "p0", "p.u < p0"))
    steps = ("cast(least(p.hi - p.lo, 24 + 9 * sqrt(p.d * (p.g / greatest(p.n, 1D))"
             " * ((p.n - p.g) / greatest(p.n, 1D)) * ((p.n - p.d) / greatest(p.n - 1, 1D)))) as int)")
    walk = f"aggregate(sequence(0, {steps}), {start}, (s, i) -> if(s.done, s, {step})).x"
    lo = "greatest(0D, a.d - (a.n - a.g))"
    hi = "least(a.d, a.g)"
    mode = f"least({hi}, greatest({lo}, floor((a.d + 1) * ((a.g + 1) / (a.n + 2)))))"
    params = f"named_struct('n', a.n, 'g', a.g, 'd', a.d, 'u', a.u, 'lo', {lo}, 'hi', {hi}, 'm', double({mode}))"
    args = (f"named_struct('n', double({n_all}), 'g', double({n_good}), 'd', double({n_draw}),"
            f" 'u', double({u}))")
    drawn = _bind(args, "a", _bind(params, "p", walk))
    return f"cast({drawn} as bigint)"


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """Deal exact quotas (sid, quota) to ``2 ** depth`` shards: rows (shard, sid, quota).

    A node is one row with the list of its sources' quotas; a level turns each node into
    its two children.
    """
    nodes = quotas.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("sid", "quota"))).alias("q")).select(
        F.lit(0).cast("long").alias("node"), "q")
    for level in range(depth):
        uniform = f"(pmod(xxhash64({seed}, {level}, node, e.sid), 9007199254740992) + 0.5D) / 9007199254740992D"
        draw = hypergeometric_sql("s.n", "e.quota", "s.d", uniform)
        fold = _bind(draw, "x",
                     "named_struct('n', s.n - e.quota, 'd', s.d - x, 'l', concat(s.l, array(x)))")
        total = "aggregate(q, 0L, (t, e) -> t + e.quota)"
        left = (f"aggregate(q, named_struct('n', {total}, 'd', {total} div 2, 'l', cast(array() as array<bigint>)),"
                f" (s, e) -> {fold}).l")
        nodes = nodes.withColumn("l", F.expr(left)).select("node", F.explode(F.expr(
            "array(named_struct('side', 0L, 'q', transform(q, (e, i) -> named_struct('sid', e.sid, 'quota', l[i]))),"
            " named_struct('side', 1L, 'q', transform(q, (e, i) -> named_struct('sid', e.sid, 'quota', e.quota - l[i]))))"
        )).alias("c")).select((F.col("node") * 2 + F.col("c.side")).alias("node"), F.col("c.q").alias("q"))
    return nodes.select(F.col("node").alias("shard"), F.explode("q").alias("e")).select(
        "shard", F.col("e.sid").alias("sid"), F.col("e.quota").alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3,
        block_words: int | None = 256, shard_blocks: int = 65_536, seed: int = 42) -> Mix:
    """Plan a mix of ``docs`` (doc_id, text, source) to target weights.

    ``draws`` has, per drawn block: shard, position in the shard, row_no (the document's
    row in ``sizes``), doc_id, pass_no, block_no, word_start and n_words.
    """
    count = F.size(words(F.col("text"))).cast("long")
    n_blocks = (F.when(F.col("size") > 0, F.lit(1)).otherwise(0) if block_words is None
                else F.ceil(F.col("size") / block_words)).cast("long")
    base = stored(docs.select("doc_id", "source", count.alias("size"), text_hash().alias("text_hash"))
                  .withColumn("row_no", F.monotonically_increasing_id()))
    sources = stored(source_targets(base, weights, max_repeats, n_blocks))
    sources_side = broadcast_if_small(sources)
    sizes = base.join(sources_side, base.source.eqNullSafe(sources.source)).drop(sources.source)

    n_all = sources.agg(F.coalesce(F.sum("source_blocks"), F.lit(0)).alias("n")).first()["n"]
    n_buckets = max(1, -(-n_all // BUCKET_BLOCKS))
    per_block = block_words or 2 ** 62
    key = F.xxhash64(F.lit(seed), "doc_id", "sid", "size", "text_hash", "block_no")
    blocks = (sizes.filter("size > 0")
              .withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
              .withColumn("key", key)
              .withColumn("bucket", F.pmod("key", F.lit(n_buckets)))
              .withColumn("word_start", F.col("block_no") * F.lit(per_block))
              .withColumn("n_words", F.least(F.lit(per_block), F.col("size") - F.col("word_start"))))
    # random order of a source's blocks: bucket, then hash inside the bucket
    starts = (blocks.groupBy("sid", "bucket")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
              .withColumn("rank0", F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n"))
              .withColumn("words0", F.sum("w").over(W.partitionBy("sid").orderBy("bucket")) - F.col("w"))
              .drop("n", "w"))
    inside = W.partitionBy("sid", "bucket").orderBy(F.xxhash64("key"), "key", "row_no")
    passes = F.when(F.col("source_size") > 0,
                    F.least(F.lit(max_repeats), F.floor(F.col("target") / F.col("source_size"))))
    ordered = (blocks.join(starts, ["sid", "bucket"])
               .withColumn("rank", F.col("rank0") + F.row_number().over(inside) - 1)
               .withColumn("words_before", F.col("words0") + F.sum("n_words").over(inside) - F.col("n_words"))
               .withColumn("whole", passes)
               .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
               .withColumn("partial", (F.col("whole") < max_repeats)
                           & (F.col("words_before") + F.col("n_words") / 2 <= F.col("rest")))
               .withColumn("times", F.col("whole") + F.col("partial").cast("int")))
    ordered = stored(ordered.select("row_no", "doc_id", "sid", "block_no", "word_start", "n_words",
                                    "source_blocks", "rank", "times"))
    quotas = ordered.groupBy("sid").agg(F.sum("times").cast("long").alias("quota")).filter("quota > 0")
    depth = max(0, (max(1, -(-n_all // shard_blocks)) - 1).bit_length())
    shards = stored(split_quotas(quotas, depth, seed).filter("quota > 0"))
    along = W.partitionBy("sid").orderBy("shard")
    runs = (shards.withColumn("end", F.sum("quota").over(along))
            .withColumn("start", F.col("end") - F.col("quota"))
            .withColumn("lane", F.explode(F.sequence(F.expr(f"start div {BUCKET_BLOCKS}"),
                                                     F.expr(f"(end - 1) div {BUCKET_BLOCKS}"))))
            .select("sid", "lane", "shard", "start", "end"))
    draws = (ordered.filter("times > 0")
             .withColumn("pass_no", F.explode(F.expr("sequence(0L, times - 1)")))
             .withColumn("draw", F.col("pass_no") * F.col("source_blocks") + F.col("rank"))
             .withColumn("lane", F.expr(f"draw div {BUCKET_BLOCKS}"))
             .join(runs, ["sid", "lane"])
             .filter("draw >= start AND draw < end"))
    local = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "sid", "draw"), "sid", "draw")
    draws = draws.withColumn("position", F.row_number().over(local)).select(
        "shard", "position", "row_no", "doc_id", "pass_no", "block_no", "word_start", "n_words")
    return Mix(sizes.select("row_no", "doc_id", "text_hash", "source", "size", "source_size", "target"), draws, shards)


def taken_words(m: Mix) -> DataFrame:
    """Per document: the words the mix takes of it, repeats counted."""
    taken = m.draws.groupBy("row_no").agg(F.sum("n_words").alias("taken"))
    return m.sizes.join(taken, "row_no", "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3,
                    shard_blocks: int = 65_536, seed: int = 42) -> DataFrame:
    """The mix as documents: rows of ``docs``, whole, as often as drawn, dealt by output shard
    and in each shard's shuffled order. Rows of equal doc_id and text stand for each other."""
    m = mix(docs, weights, max_repeats, None, shard_blocks, seed)
    drawn = (m.draws.select("row_no", "shard", "position").join(m.sizes.select("row_no", "doc_id", "text_hash"), "row_no")
             .groupBy(F.col("doc_id").alias("__ll_id"), F.col("text_hash").alias("__ll_hash"))
             .agg(F.collect_list(F.struct("shard", "position")).alias("__ll_places")))
    one = W.partitionBy("doc_id", "__ll_text").orderBy(F.xxhash64(*docs.columns))
    rows = (docs.withColumn("__ll_text", text_hash())
            .join(drawn, F.col("doc_id").eqNullSafe(F.col("__ll_id")) & (F.col("__ll_text") == F.col("__ll_hash")))
            .withColumn("__ll_no", F.row_number().over(one)).filter("__ll_no = 1"))
    placed = rows.withColumn("__ll_place", F.explode("__ll_places"))
    order = [F.col("__ll_place.shard"), F.col("__ll_place.position")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
