"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn.  Their first characters are spaced out where a role or text contains them.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns ``(role, text)`` in order of ``turn``."""
    plain = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    turn = F.struct("turn", plain("role").alias("role"), plain("text").alias("text"))
    listed = F.array_sort(F.collect_list(turn))
    return conversations.where("conv_id is not null").groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common before they part."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    parting = F.array_position(same, F.lit(False))
    return F.when(parting > 0, parting - 1).otherwise(F.size(same).cast("long")).cast("int")


def rendered(turns: Column) -> Column:
    """Turns as text: an opening mark with the role, the text, a closing mark, each turn ending its line."""
    each = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n")))
    return F.array_join(each, "")


def loss_mask(turns: Column) -> Column:
    """Run lengths, in characters of :func:`rendered`: minus those that are masked, plus those that train.

    What an assistant says trains, its closing mark included; its opening mark, line ends and all other turns
    are masked.
    """
    def runs(t: Column) -> Column:
        head, said = F.length(t["role"]) + len(OPEN) + 1, F.length(t["text"]) + len(CLOSE)
        return F.when(t["role"] == "assistant", F.array(-head, said, F.lit(-1))).otherwise(F.array(-(head + said + 1)))

    return F.flatten(F.transform(turns, runs))


def conversation_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)``, the turns of both conversations of ``pairs(pair_id, chosen_id, rejected_id)``.

    A conversation in very many pairs is a skewed key of these joins, which adaptive execution splits.
    """
    turns = turns_of(conversations)
    sides = [turns.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").alias(side)) for side in ("chosen", "rejected")]
    rows = pairs.select("pair_id", "chosen_id", "rejected_id").join(sides[0], "chosen_id", "left").join(sides[1], "rejected_id", "left")
    return rows.select("pair_id", "chosen", "rejected")


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)`` for every conversation: its own last answer, and another's in the same place.

    ``chosen`` are its turns up to the last of the assistant, or all if it has none; what follows would train
    nothing.  ``rejected`` has the last assistant turn of the conversation with the next id instead; without
    either it is null.  A conversation is joined once, so no key is skewed.
    """
    last = F.expr("size(turns) - array_position(reverse(transform(turns, t -> t.role = 'assistant')), true) + 1")
    turns = turns_of(conversations).withColumn("last", F.when(F.exists("turns", lambda t: t["role"] == "assistant"), last).cast("int"))
    answers = turns.where("last is not null").select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", F.col("last")).alias("answer"))
    rows = turns.join(answers, "conv_id", "left")
    return rows.select(
        F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.coalesce("last", F.size("turns"))).alias("chosen"),
        F.when(F.col("last").isNotNull() & F.col("answer").isNotNull(), F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array("answer"))).alias("rejected"),
    )


def preference_examples(pairs: DataFrame) -> DataFrame:
    """``(pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask, usable)`` for ``pairs(pair_id, chosen, rejected)``.

    The longest common prefix of turns is rendered once, as the prompt.  What is left of either conversation
    is its completion, with a mask of run lengths (:func:`loss_mask`).  A pair is ``usable`` if the
    completions differ and both have something that trains.

    Conversations are gathered by one shuffle (:func:`turns_of`); one conversation must fit a row, as its
    example does.  Turns with a null conversation are left out; null roles and texts are empty; turns of the
    same number are ordered by role and text; repeated turns stay; a pair that lacks a conversation has no
    common turns, a null completion there, and is not usable; an empty table gives no rows; other columns are
    not read.
    """
    rows = pairs.withColumn("n_common", F.coalesce(common_turns(F.col("chosen"), F.col("rejected")), F.lit(0)))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    prompt = F.coalesce(rendered(F.slice("chosen", F.lit(1), F.col("n_common"))), F.lit(""))
    rows = rows.withColumns({"prompt": prompt, "chosen": rest("chosen"), "rejected": rest("rejected")})
    out = rows.select(
        "pair_id", "n_common", "prompt", rendered(F.col("chosen")).alias("chosen"), loss_mask(F.col("chosen")).alias("chosen_mask"),
        rendered(F.col("rejected")).alias("rejected"), loss_mask(F.col("rejected")).alias("rejected_mask"),
    )
    trains = lambda c: F.exists(c, lambda n: n > 0)
    usable = (F.col("chosen") != F.col("rejected")) & trains("chosen_mask") & trains("rejected_mask")
    return out.withColumn("usable", F.coalesce(usable, F.lit(False)))
