"""Chat formatting in budgeted windows.

A conversation's turns are formatted with a template that marks turns; control strings
inside texts are escaped, reversibly. Prefix sums of turn tokens choose turn-aligned spans:
a window holds the system turn (the first turn, if its role is ``system``), at most
``history`` tokens of the turns just before (repeated, their targets masked) and new turns.
Every turn is new in exactly one window, and the loss mask covers each target text there
and nowhere else. No turn is cut: a turn longer than the room gets a window of its own, so
only such a window can exceed ``budget``.

Everything is window functions, aggregates and array functions over one exchange by
conversation; nothing is folded turn by turn, so cost is linear in a conversation's length.

Defined cases: null text or role is empty; rows of one conversation are ordered by turn
(null first), role and text, so ties and repeated rows have a fixed order and each counts as
a turn; null conv_id is a conversation of its own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# template marks (fixed values)
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Hide marks: ``\`` becomes ``\b``, a bar after ``<`` becomes ``\p``, a line feed ``\n``
    only where asked for (roles). Every backslash is then followed by its code."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\p"), F.lit("|"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def approximate_tokens(text: Column) -> Column:
    """Four code points count as a token; the template adds four."""
    return F.ceil(F.length(text) / 4) + 4


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256,
                   system_role: str = "system", target_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, window_no, text, n_repeated, spans): the formatted windows.

    The first ``n_repeated`` turns of a window are repeated context; ``spans`` lists the
    loss mask as (start, length) in code points of ``text``, start counted from 1.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    by_turn = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = W.partitionBy("conv_id")
    t = t.withColumn("idx", F.row_number().over(by_turn) - 1)
    by_idx = W.partitionBy("conv_id").orderBy("idx")
    is_system = (F.col("idx") == 0) & (F.col("role") == system_role)
    t = t.withColumn("is_system", is_system).withColumn("tokens", approximate_tokens(F.col("text")).cast("long"))
    t = t.withColumn("body", F.when(F.col("is_system"), 0).otherwise(F.col("tokens")))
    system_tokens = F.coalesce(F.max(F.when(F.col("is_system"), F.col("tokens"))).over(by_idx), F.lit(0))
    t = (t.withColumn("end", F.sum("body").over(by_idx))
         .withColumn("begin", F.col("end") - F.col("body"))
         # a span may overhang its half-room slot by less than the other half
         .withColumn("half", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - system_tokens) / 2)))
         .withColumn("long", F.col("body") > F.col("half")))
    since = F.coalesce(F.max(F.when(F.col("long"), F.col("end"))).over(by_idx.rowsBetween(W.unboundedPreceding, -1)),
                       F.lit(0))
    slot = F.when(F.col("long"), F.lit(-1)).otherwise(F.floor((F.col("begin") - F.col("since")) / F.col("half")))
    t = (t.withColumn("since", since)
         .withColumn("span", F.when(~F.col("is_system"), F.struct("since", slot.alias("slot"))))
         .withColumn("opens", ~F.col("is_system") & ~F.col("span").eqNullSafe(F.lag("span").over(by_idx)))
         .withColumn("window_no", F.greatest(F.lit(0), F.sum(F.col("opens").cast("int")).over(by_idx) - 1)))
    later = W.partitionBy("conv_id").orderBy("begin").rangeBetween(1, max(1, history))
    seen_again = F.collect_list(F.when(F.col("opens"), F.col("window_no"))).over(later)
    t = t.withColumn("again", seen_again if history > 0 else F.array().cast("array<int>"))
    t = t.withColumn("last_window", F.max("window_no").over(whole))
    places = F.when(F.col("is_system"),
                    F.transform(F.sequence(F.lit(0), F.col("last_window")),
                                lambda w: F.struct(w.alias("window_no"), (w > 0).alias("repeated")))
                    ).otherwise(F.concat(
                        F.array(F.struct(F.col("window_no"), F.lit(False).alias("repeated"))),
                        F.transform(F.col("again"), lambda w: F.struct(w.alias("window_no"), F.lit(True).alias("repeated")))))
    safe_role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    t = (t.withColumn("head", F.concat(F.lit(TURN_START), safe_role, F.lit("\n")))
         .withColumn("body_text", escape(F.col("text")))
         .withColumn("is_target", F.col("role") == target_role)
         .select("conv_id", "idx", "head", "body_text", "is_target", F.explode(places).alias("place"))
         .select("conv_id", "idx", "place.window_no", "place.repeated", "is_target",
                 F.length("head").alias("head_chars"), F.length("body_text").alias("body_chars"),
                 F.concat("head", "body_text", F.lit(TURN_END + "\n")).alias("piece")))
    inside = W.partitionBy("conv_id", "window_no").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("before", F.coalesce(F.sum(F.length("piece")).over(inside), F.lit(0)))
    span = F.when(F.col("is_target") & ~F.col("repeated"),
                  F.struct((F.col("before") + F.col("head_chars") + 1).cast("int").alias("start"),
                           F.col("body_chars").alias("length")))
    return (t.withColumn("mask", span).groupBy("conv_id", "window_no").agg(
        F.sort_array(F.collect_list(F.struct("idx", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list("mask")).alias("spans"),
        F.sum(F.col("repeated").cast("int")).cast("int").alias("n_repeated"))
        .select("conv_id", "window_no", F.array_join(F.col("pieces.piece"), "").alias("text"),
                "n_repeated", "spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Read formatted windows back: the new turns (unescaped role and text) and the texts
    under the loss mask, per window."""
    marked = F.split("text", TURN_END.replace("|", r"\|") + "\n")
    pieces = F.slice(marked, F.col("n_repeated") + 1, F.size(marked) - 1 - F.col("n_repeated"))

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(TURN_START) + 1, 2 ** 31 - 1)
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescape(role).alias("role"),
                        unescape(F.substr(inner, F.length(role) + 2)).alias("text"))

    return windows.select(
        "conv_id", "window_no", "text", F.transform(pieces, turn).alias("turns"),
        F.transform("spans", lambda s: unescape(F.substr(F.col("text"), s["start"], s["length"]))).alias("targets"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows read back: counts and digests."""
    r = read_windows(windows).select(
        "conv_id", "window_no", F.size("turns").alias("n"), F.length("text").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("target"))
    g = r.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window_no", "said", "target"))).alias("parts"),
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    loss = F.array_join(F.col("parts.target"), "")
    return g.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("parts.said"), ""), 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                    "formatted_chars")
