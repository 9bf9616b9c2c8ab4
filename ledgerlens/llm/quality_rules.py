"""Quality rules with adaptive thresholds.

Per document, counts of words, characters, symbols, repeated lines and repeated five-word
windows. Instead of fixed cutoffs, every rule's threshold comes from the distribution of its
measure among documents of the same language and source: a mergeable quantile sketch (counts
per logarithmic bin, relative error ``SKETCH_ERROR``) is built per language, source and
measure by plain counting, so sketches add up exactly and do not depend on partitioning.
Groups with fewer than ``min_group`` documents use the merged sketch of their language, and
failing that of all documents. Thresholds are then joined back and documents filtered.

The fence of a measure is ``upper quartile + 4 * spread + FLOOR``: up to a quarter of a group may
be junk. The spread is the distance of the quartiles. Where the upper quartile is 0, the
measure's non-zero part tells it: its lower quartile (junk gathers in the non-zero part, so its
lower end is the safer one) times its share of the group. So what is usual among
few documents of a group allows little, and what is usual among many allows more. ``FLOOR`` only
keeps a fence of a group without any spread off its quartile. The first ``UNITS`` occurrences of
what a measure counts (a repeated line, a few symbols) are no evidence in any group.

All of it is DataFrame and SQL functions.

Defined cases: null or blank text has no words and fails the base rule; null language and
null source are groups of their own; repeated rows are judged one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, words

SKETCH_ERROR = 0.02
# least distance of a fence from the upper quartile: shares of characters, lines or words
FLOOR = {"symbol_share": 0.01, "upper_share": 0.02, "mark_share": 0.01, "dup_line_share": 0.02, "repeat_share": 0.02,
         "word_length": 0.5}
# symbols, marks, repeated lines and words in repeated windows that a measure does not count
UNITS = {"symbol_share": 2, "mark_share": 2, "dup_line_share": 1, "repeat_share": 20}
SPREADS = 4
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(w: str, k: int = 5) -> Column:
    """Words of array column ``w`` that lie in a ``k``-word window found twice or more."""
    window = ", ".join(f"{w}[i + {j}]" for j in range(k))
    hashes = f"transform(sequence(0, size({w}) - {k}), i -> xxhash64({window}))"
    sorted_ = "array_sort(transform(h, (x, i) -> struct(x as x, i as i)))"
    repeated = ("sort_array(transform(filter(s, (e, j) -> (j > 0 AND s[j - 1].x = e.x)"
                " OR (j < size(s) - 1 AND s[j + 1].x = e.x)), e -> e.i))")
    covered = (f"aggregate(p, struct(0L as n, -{k} as last), (a, i) ->"
               f" struct(a.n + least({k}, i - a.last) as n, i as last)).n")
    return F.expr(
        f"CASE WHEN size({w}) <= {k} THEN 0L ELSE element_at(transform(array({hashes}), h ->"
        f" CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE"
        f" element_at(transform(array({sorted_}), s -> element_at(transform(array({repeated}), p -> {covered}), 1)), 1)"
        f" END), 1) END")


def document_measures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, the base counts and helper counts."""
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != "")
    d = d.withColumn("joined", F.array_join("w", "")).withColumn("lines", lines)

    def kept_chars(pattern: str) -> Column:
        return F.length(F.regexp_replace("joined", pattern, "")).cast("long")

    return d.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        kept_chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words("w").cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        kept_chars(r"[^\p{Lu}]+").alias("n_upper"),
        kept_chars(r"[^!?]+").alias("n_marks"))


def _shares() -> dict[str, Column]:
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    count = F.greatest(F.col("n_words"), F.lit(1))

    def beyond(count: str, measure: str) -> Column:
        return F.greatest(F.col(count) - UNITS[measure], F.lit(0))

    return {"symbol_share": beyond("n_symbols", "symbol_share") / chars, "upper_share": F.col("n_upper") / chars,
            "mark_share": beyond("n_marks", "mark_share") / chars,
            "dup_line_share": beyond("n_dup_lines", "dup_line_share") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": beyond("n_repeat_words", "repeat_share") / count, "word_length": F.col("word_chars") / count}


def sketches(measures: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, bin): a quantile sketch that merges by adding."""
    gamma = math.log((1 + SKETCH_ERROR) / (1 - SKETCH_ERROR))
    return (measures.select("lang", "source", F.explode(F.create_map(
        *[x for name, share in _shares().items() for x in (F.lit(name), share)])).alias("measure", "value"))
        .withColumn("bin", F.when(F.col("value") > 0, F.ceil(F.log("value") / gamma)))
        .groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketch: DataFrame, keys: list[str], qs: dict[str, float],
              nonzero_qs: dict[str, float] | None = None) -> DataFrame:
    """Quantiles per ``keys`` and measure from (merged) sketches, of all values and of the
    non-zero ones (null, if there are none)."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    up = group.orderBy(F.col("bin").asc_nulls_first())
    ratio = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)
    value = F.coalesce(2 * F.pow(F.lit(ratio), F.col("bin")) / (ratio + 1), F.lit(0.0))
    c = (merged.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(group))
         .withColumn("zeros", F.coalesce(F.max(F.when(F.col("bin").isNull(), F.col("n"))).over(group), F.lit(0)))
         .withColumn("value", value))
    above = F.col("total") - F.col("zeros")
    return c.groupBy(*keys, "measure").agg(
        F.max("total").alias("group_size"), F.max(above).alias("n_nonzero"),
        *[F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value"))).alias(name) for name, q in qs.items()],
        *[F.min(F.when(F.col("bin").isNotNull() & (F.col("upto") - F.col("zeros") >= q * above), F.col("value"))).alias(name)
          for name, q in (nonzero_qs or {}).items()])


def thresholds(sketch: DataFrame, min_group: int) -> DataFrame:
    """One row per (lang, source): a fence for every measure."""
    floor = F.create_map(*[x for k, v in FLOOR.items() for x in (F.lit(k), F.lit(v))])
    rare = F.coalesce(F.col("n_nonzero") * F.col("usual") / F.col("group_size"), F.lit(0.0))
    spread = F.when(F.col("q75") > 0, F.col("q75") - F.col("q25")).otherwise(rare)
    fence = F.col("q75") + SPREADS * spread + floor[F.col("measure")]

    def level(keys: list[str], tag: str) -> DataFrame:
        return quantiles(sketch, keys, {"q25": 0.25, "q75": 0.75}, {"usual": 0.25}).select(*[F.col(k).alias(f"{tag}_{k}") for k in keys],
                                                  F.col("measure").alias(f"{tag}_measure"),
                                                  F.col("group_size").alias(f"{tag}_size"), fence.alias(f"{tag}_fence"))

    own, by_lang, overall = level(["lang", "source"], "own"), level(["lang"], "lang"), level([], "all")
    t = (own.join(by_lang, F.col("own_lang").eqNullSafe(F.col("lang_lang"))
                  & (F.col("own_measure") == F.col("lang_measure")))
         .join(overall, F.col("own_measure") == F.col("all_measure")))
    chosen = (F.when(F.col("own_size") >= min_group, F.col("own_fence"))
              .when(F.col("lang_size") >= min_group, F.col("lang_fence")).otherwise(F.col("all_fence")))
    return t.groupBy(F.col("own_lang").alias("t_lang"), F.col("own_source").alias("t_source")).agg(
        *[F.max(F.when(F.col("own_measure") == name, chosen)).alias(f"max_{name}") for name in FLOOR])


def judge(docs: DataFrame, min_group: int = 50) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``kept`` and the rules it broke."""
    m = stored(document_measures(docs))
    t = broadcast_if_small(stored(thresholds(sketches(m), min_group)))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(share > F.col(f"max_{name}"), F.lit(name))
                                for name, share in _shares().items()]), lambda x: x.isNotNull())
    return (m.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
            .withColumn("base_failed", base_failed).withColumn("broken_rules", broken)
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
            .select("doc_id", *BASE_COLUMNS, "base_failed", "kept", "broken_rules"))
