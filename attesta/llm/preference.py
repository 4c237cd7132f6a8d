"""Preference formatting: one prompt from the turns two conversations share, and a masked completion for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is rendered as HEADER % role, its text, then FOOTER.
HEADER, FOOTER = "<|%s|>\n", "<|end|>\n"
#: The role whose text (with the footer) is trained on.
TRAINED_ROLE = "assistant"


def _rendered(turns: Column) -> Column:
    head, tail = HEADER.split("%s")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(head), t["role"], F.lit(tail), t["text"], F.lit(FOOTER))), "")


def _mask(turns: Column, role: str) -> Column:
    """Character ranges of the rendered turns that count for the loss."""
    around = len(HEADER) - 2
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + around + F.length(turn["role"])
        stop = begin + F.length(turn["text"]) + len(FOOTER)
        own = F.array(F.struct(begin.cast("long").alias("start"), stop.cast("long").alias("stop")))
        return F.struct(stop.cast("long").alias("at"), F.when(turn["role"] == role, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, role: str = TRAINED_ROLE) -> DataFrame:
    """One row per pair of conversations in ``turns`` (turn, role, text).

    ``pair`` (an expression over the rows) names the pair, ``chosen`` is true for turns of the
    preferred conversation and false for the other's. Columns: pair_id, paired (both
    have turns), n_common (turns of the longest common prefix: same role and text),
    prompt (those turns rendered once), chosen and rejected (the remaining turns rendered),
    chosen_mask and rejected_mask (array<struct<start, stop>>: characters of the completion that are
    trained on, the ``role``'s texts with their end marks).

    Turns go by number; equal or null numbers by role and text, nulls first. A null role or text
    counts as empty. A missing conversation has no turns, so the other one is all
    completion. Conversations that are equal give two empty completions. Rows whose pair
    or side is null belong to no conversation and are left out. Further columns are ignored.
    One shuffle by pair brings the turns of a pair together; everything else is in the row, so the texts of a pair must
    fit one row (2 GB).
    """
    rows = turns.select(pair.alias("pair_id"), chosen.alias("side"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    rows = rows.where(F.col("pair_id").isNotNull() & F.col("side").isNotNull())
    sides = rows.groupBy("pair_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(on, F.col("t")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(n) for n, on in (("c", F.col("side")), ("r", ~F.col("side")))])
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("going"))
    step = lambda s, same: F.struct((s["n"] + (s["going"] & same).cast("long")).alias("n"), (s["going"] & same).alias("going"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce(x == y, F.lit(False)))
    common = sides.withColumn("n_common", F.aggregate(same, start, step, lambda s: s["n"]))
    rest = lambda side: F.slice(side, F.col("n_common").cast("int") + 1, F.greatest(F.size(side), F.lit(1)))
    cut = common.select("pair_id", ((F.size("c") > 0) & (F.size("r") > 0)).alias("paired"), "n_common", F.slice("c", F.lit(1), F.col("n_common").cast("int")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select("pair_id", "paired", "n_common", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("c"), role).alias("chosen_mask"), _mask(F.col("r"), role).alias("rejected_mask"))
