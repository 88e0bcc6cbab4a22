"""Preference formatting: one prompt for both sides, then two masked completions.

The turns of a chosen and a rejected conversation meet by turn number. The first number at
which they differ ends their common prefix; what is before is rendered once as the prompt,
what follows as one completion for each side, with the stretches that count for the loss.
Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import previous_values
from .common import durable, narrow

HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
#: Turns of a pair that are rendered into one row; longer pairs go on in further rows.
PAGE_TURNS = 256
#: Conversations of one bucket of the ring, about.
RING_BUCKET = 4096


def _head(role: Column) -> Column:
    return F.concat(F.lit(HEAD.split("{role}")[0]), role, F.lit(HEAD.split("{role}")[1]))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(TAIL))), "")


def _mask(turns: Column) -> Column:
    """(start, end) in code points of the rendered turns: text and end mark of the trained role."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def add(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t["role"]))
        end = start + F.length(t["text"]) + len(TAIL)
        own = F.array(F.struct((start + 0).alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(a["out"], own)).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, begin, add, lambda a: a["out"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, page, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask).

    ``turns`` hold pair_id, chosen (boolean: the side), turn, role and text; other columns
    are ignored. Rows without pair, side or turn are ignored; a null text is empty, a null
    role is ``unknown``. If a turn of a side comes more than once, the smallest (role, text) stands.
    Masks are arrays of (start, end) in code points of the completion. Identical sides have
    empty completions; sides without a common turn an empty prompt; a side that is missing
    or a prefix of the other an empty completion. ``prefix_turns`` counts prompt turns of
    the row. Every pair gives one row (page 0) unless its turns span PAGE_TURNS numbers or more.
    """
    rows = narrow(turns, pair_id="pair_id", chosen="chosen", turn="turn", role="role", text="text")
    rows = rows.where("pair_id is not null and chosen is not null and turn is not null")
    said = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = rows.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("chosen"), said)).alias("c"), F.min(F.when(~F.col("chosen"), said)).alias("r"))
    split = both.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("split"))
    both = both.join(split, "pair_id")
    # a page holds at most PAGE_TURNS turns, however long the conversation
    page = F.floor(F.col("turn") / PAGE_TURNS).cast("long")
    pages = both.withColumn("page", page).groupBy("pair_id", "page", "split").agg(F.array_sort(F.collect_list(F.struct("turn", "c", "r"))).alias("t"))

    def side(name: str, prompt: bool) -> Column:
        shared = lambda x: F.coalesce(x["turn"] < F.col("split"), F.lit(True))
        kept = F.filter("t", lambda x: (shared(x) if prompt else ~shared(x)) & x[name].isNotNull())
        return F.transform(kept, lambda x: x[name])

    pages = pages.select("pair_id", "page", side("c", True).alias("p"), side("c", False).alias("c"), side("r", False).alias("r"))
    return pages.select(
        "pair_id",
        "page",
        F.size("p").cast("long").alias("prefix_turns"),
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def pairs_by_swap(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs made from single conversations (conv_id, turn, role, text).

    Chosen is the whole conversation. Rejected is the same up to one of its replies, picked
    by a hash, where it goes another way: it ends with the picked reply of another
    conversation. Conversations with a reply stand in a ring by a hash of their id, and each
    takes the reply of the next one, so every one of them gives a pair, whatever gaps the
    ids (whole numbers) have; a single one takes its own. Rows without id or turn are
    ignored; of repeated turns the smallest (role, text) stands.
    """
    rows = narrow(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null and turn is not null")
    said = F.min(F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said")
    rows = rows.groupBy("conv_id", "turn").agg(said).select("conv_id", "turn", "said.*")

    pick = F.struct(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("pick"), "turn", "text")
    place = F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 15), 16, 10).cast("long")  # 60 bits
    replies = rows.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(pick).alias("p"))
    ring = durable(replies.select("conv_id", F.col("p.turn").alias("branch"), F.col("p.text").alias("reply"), place.alias("place")))
    # Hashes are spread evenly, so buckets of them are of one size.
    width = (1 << 60) // max(1, ring.count() // RING_BUCKET)
    ring = ring.withColumn("down", F.struct((-F.col("place")).alias("a"), (-F.col("conv_id")).alias("b")))
    following = previous_values(ring, [], "down", F.floor(-F.col("place") / width), {"other": "reply"})
    first = ring.select(F.min_by("reply", F.struct("place", "conv_id"))).scalar()
    following = following.select("conv_id", "branch", F.coalesce("other", first).alias("other"))

    met = rows.join(following, "conv_id")
    swapped = F.when(F.col("turn") == F.col("branch"), F.col("other")).otherwise(F.col("text"))
    rejected = F.struct(F.lit(False).alias("chosen"), swapped.alias("text"))
    sides = F.array_compact(F.array(F.struct(F.lit(True).alias("chosen"), F.col("text").alias("text")), F.when(F.col("turn") <= F.col("branch"), rejected)))
    return met.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.chosen", "turn", "role", "s.text")
