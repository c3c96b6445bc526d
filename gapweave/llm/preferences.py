"""Preference formatting: chosen and rejected conversations to prompt and masked completions.

The longest common prefix of turns is rendered once as the prompt; what is left of either
conversation becomes its completion, with the character spans on which to train: the text
and the end mark of assistant turns. All else in a completion is masked.

Defined results: turns are equal if role and text are, nulls being equal to nulls; null
text is rendered as empty, a null role as ``user``; equal conversations leave two empty
completions; marks inside a text are broken by a blank so that no text can end a turn. Turns
of one number are ordered by role, then text, nulls first, and a repeated turn is a turn of its
own; texts are rendered whole. Empty tables give no pairs. ``reply_pairs`` reads its four
columns only; ``format_preferences`` keeps further ones, but for the names of its results and
``_c``, ``_r``, ``_p`` and ``_n``, which are replaced or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(_safe(turn["role"]), F.lit("user")), F.lit("\n"))


def _tail(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t), F.lit("\n"))), "")


def trained_spans(turns: Column, role: str = "assistant") -> Column:
    """Character spans ``[start, end)`` of the rendered turns on which to train."""
    sized = F.transform(
        turns,
        lambda t: F.struct(
            F.length(_head(t)).alias("head"), F.length(_tail(t)).alias("tail"), t["role"].eqNullSafe(F.lit(role)).alias("on")
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["head"] + t["tail"] + 1).alias("at"),
            F.when(
                t["on"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + t["head"]).alias("start"), (a["at"] + t["head"] + t["tail"]).alias("end")
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns two conversations share."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace two arrays of turns by ``n_prefix``, ``prompt``, completions and their spans."""
    none = F.array().cast(TURNS)
    both = pairs.withColumns({"_c": F.coalesce(F.col(chosen), none), "_r": F.coalesce(F.col(rejected), none)})
    both = both.withColumn("_n", common_prefix(F.col("_c"), F.col("_r")))
    rest = lambda side: F.slice(F.col(side), F.col("_n") + 1, F.size(side))
    both = both.withColumns({"_p": F.slice("_c", 1, F.col("_n")), "_c": F.when(F.col("_n") < F.size("_c"), rest("_c")).otherwise(none), "_r": F.when(F.col("_n") < F.size("_r"), rest("_r")).otherwise(none)})
    return both.drop(chosen, rejected, "n_prefix", "prompt", "chosen_spans", "rejected_spans").withColumns(
        {
            "n_prefix": F.col("_n"),
            "prompt": render(F.col("_p")),
            chosen: render(F.col("_c")),
            rejected: render(F.col("_r")),
            "chosen_spans": trained_spans(F.col("_c")),
            "rejected_spans": trained_spans(F.col("_r")),
        }
    ).drop("_c", "_r", "_p", "_n")


def reply_pairs(turns: DataFrame) -> DataFrame:
    """A pair per conversation: its last assistant reply against its neighbour's.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``. The neighbour is the
    conversation whose id differs in the lowest bit; both meet in one group, so turns are
    shuffled once. Without a neighbour's reply the rejected side stops before the reply; a
    conversation without one is its own prompt. Turns of a null ``conv_id`` belong to no
    conversation. The turns of a conversation make one record, so they meet in one task.
    """
    turn = F.struct("conv_id", "turn", "role", "text")
    group = (
        turns.where(F.col("conv_id").isNotNull())
        .groupBy(F.shiftright("conv_id", 1).alias("_g"))
        .agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    )
    ids = F.array_distinct(F.transform("_t", lambda t: t["conv_id"]))
    reply = lambda t: t["role"].eqNullSafe(F.lit("assistant"))
    each = group.select("_t", F.explode(ids).alias("conv_id"))
    mine = lambda t: t["conv_id"] == F.col("conv_id")
    other = lambda t: t["conv_id"] != F.col("conv_id")
    each = each.select(
        "conv_id",
        F.filter("_t", mine).alias("_own"),
        F.get(F.slice(F.reverse(F.filter(F.col("_t"), lambda t: other(t) & reply(t))), 1, 1), F.lit(0)).alias("_theirs"),
    )
    where = F.transform("_own", lambda t, i: F.when(reply(t), i + 1).otherwise(0))
    each = each.withColumn("_end", F.array_max(where))
    plain = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    before = plain(F.slice("_own", 1, F.greatest(F.col("_end") - 1, F.lit(0))))
    swapped = F.when(
        F.col("_theirs").isNotNull(),
        F.concat(before, F.array(F.struct(F.lit("assistant").alias("role"), F.col("_theirs.text").alias("text")))),
    ).otherwise(before)
    whole = plain(F.col("_own"))
    return each.select(
        "conv_id",
        F.when(F.col("_end") > 0, plain(F.slice("_own", 1, F.col("_end")))).otherwise(whole).alias("chosen"),
        F.when(F.col("_end") > 0, swapped).otherwise(whole).alias("rejected"),
    )
