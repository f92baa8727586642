"""Chat formatting by perspective rotation: a dialogue once for every participant, who is then the assistant.

Each turn is rendered as

    <|assistant|>\\n{text}<|end|>\\n          for the speaker whose perspective it is
    <|user:{name}|>\\n{text}<|end|>\\n        for any other participant
    <|system|>\\n{text}<|end|>\\n             for system turns, which belong to nobody

and the mask covers the speaker's own text with its end mark. The result has one row per turn and perspective with
its span in the rendered dialogue, so no conversation, however long, is gathered in one task; `render` joins the
rows of dialogues that fit in memory. Marks inside a text are written with a space after "<", so a turn can't
forge another.

Defined cases: null role is the participant "unknown", null or empty text an empty turn, a very long text one turn
like any other; turns are ordered by (turn, role, text), nulls first, repeated rows staying side by side; rows with
a null conv_id are one dialogue; a dialogue of system turns only has no participant and gives no rows; further
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import keep

SYSTEM = "system"
END = "<|end|>\n"


def _head(role: Column, own: Column) -> Column:
    """What stands before a turn's text."""
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>\n")))


def rotate(turns: DataFrame) -> DataFrame:
    """One row per (conv_id, perspective, turn): position, rendered, start, end, mask_start, mask_end (code points).

    Turns are dealt to ranges of (conv_id, turn), so a long dialogue is many parts. Where a part starts in each
    perspective is computed from lengths alone, one narrow row per part and participant; then the parts meet these
    rows by (conv_id, part), and spans are running sums within a part. Texts are shuffled twice, whatever the
    number of participants.
    """
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", safe(F.coalesce("role", F.lit("unknown"))).alias("role"), safe(F.col("text")).alias("body"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("body")]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    # a null conv_id is a key like others in the joins below
    keys = {"part": F.spark_partition_id(), "none": F.col("conv").isNull(), "conv": F.coalesce("conv", F.lit(0)), "n_body": F.length("body") + len(END)}
    dealt = keep(dealt.withColumns(keys), "turns")
    as_other, as_own = F.length(_head(F.col("role"), F.lit(False))), F.length(_head(F.col("role"), F.lit(True)))

    # lengths: of a part as nobody's own, and how much shorter it is for each of its speakers
    talk, part = ["conv", "none"], ["conv", "none", "part"]
    of_role = keep(dealt.groupBy(*part, "role").agg(F.sum(F.col("n_body") + as_other).alias("length"), F.sum(as_other - as_own).alias("less"), F.count(F.lit(1)).alias("turns")), "lengths")
    of_part = of_role.groupBy(*part).agg(F.sum("length").alias("length"), F.sum("turns").alias("turns"))
    people = of_role.where(F.col("role") != SYSTEM).select(*talk, F.col("role").alias("perspective")).distinct()
    each = of_part.join(people, talk).join(of_role.select(*part, F.col("role").alias("perspective"), "less"), [*part, "perspective"], "left")
    before = Window.partitionBy(*talk, "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    given = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    places = each.select(*part, "perspective", given(F.col("length") - F.coalesce("less", F.lit(0))).alias("chars_before"), given(F.col("turns")).alias("turns_before"))

    own = F.col("role") == F.col("perspective")
    shown = dealt.join(places, part).withColumn("head", _head(F.col("role"), own)).withColumn("n", F.length("head") + F.col("n_body"))
    line = Window.partitionBy(*part, "perspective").orderBy(F.col("turn").asc_nulls_first(), "role", "body").rowsBetween(Window.unboundedPreceding, 0)
    shown = shown.withColumns({"upto": F.sum("n").over(line), "nth": F.count(F.lit(1)).over(line)})
    start = (F.col("chars_before") + F.col("upto") - F.col("n")).cast("long")
    return shown.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "perspective", "turn", (F.col("turns_before") + F.col("nth") - 1).cast("long").alias("position"), "role",
        F.concat("head", "body", F.lit(END)).alias("rendered"), start.alias("start"), (start + F.col("n")).cast("long").alias("end"),
        F.when(own, start + F.length("head")).cast("long").alias("mask_start"), F.when(own, start + F.col("n")).cast("long").alias("mask_end"),
    )


def render(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, mask): whole dialogues, for those that fit in a row."""
    item = F.struct("position", "rendered", F.struct("mask_start", "mask_end").alias("span"))
    whole = rotated.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(item)).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda s: s["mask_start"].isNotNull())
    return whole.select("conv_id", "perspective", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("text"), spans.alias("mask"))
