"""Page text: lines from positioned items, regrouping of lines into records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc
from ..session import durable
from .ranking import FAN, earlier_totals, previous_values, running_count

ITEMS_PER_BUCKET = 4096


def page_lines(items: DataFrame, keys: Sequence[str] = ("file_id", "page"), bucket: Column | None = None) -> DataFrame:
    """Join text items into lines: a new line starts where y changes. Text is NFKC.

    Items are shuffled once and gathered bucket by bucket, so one page with very many items
    is spread over tasks; a bucket becomes one row with its pieces of lines. By default a
    bucket is a run of ITEMS_PER_BUCKET item numbers; where these have gaps, ``bucket`` gives
    coarser runs. These rows are stored in the shared folder, as they are read several times:
    lines are numbered, and those that cross a border put together, from one row per bucket;
    its totals are added up in two levels, so a page may have any number of buckets. Output:
    keys, line_no (0-based), text.
    """
    bucket = F.floor(F.col("item_no") / ITEMS_PER_BUCKET) if bucket is None else bucket
    # Dealt before they are gathered: else each task would first sort the items it reads. As one
    # column, as a constant key would drop out of the grouping alone and the items be shuffled again.
    dealt = items.select(F.struct(*keys, bucket.alias("__part")).alias("__key"), "item_no", "y", "str").repartition("__key")
    gathered = dealt.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("item_no", "str", "y"))).alias("__items"))

    def y_of(i: Column) -> Column:
        return F.get("__items", i)["y"]

    n = F.size("__items")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | F.coalesce(y_of(i - 1) != y_of(i), F.lit(False)))
    until = F.concat(F.slice("__start", 2, F.size("__start")), F.array(n))
    spans = F.zip_with("__start", "__until", lambda i, j: F.array_join(F.slice("__items", i + 1, j - i)["str"], ""))
    cut = gathered.withColumn("__start", starts).withColumn("__until", until)
    buckets = durable(cut.select("__key.*", spans.alias("__pieces"), y_of(F.lit(0)).alias("__first_y"), y_of(n - 1).alias("__last_y")))
    placed = buckets.select(*keys, "__part", "__pieces").join(_bucket_lines(buckets, keys), [*keys, "__part"])
    each = placed.select(*keys, "__opened", "__joins", "__rest", F.size("__pieces").alias("__n"), F.posexplode("__pieces").alias("__pos", "text"))
    own = each.filter(F.col("__pos") >= F.col("__joins"))
    rest = F.when(F.col("__pos") == F.col("__n") - 1, F.col("__rest"))
    return own.select(
        *keys, (F.col("__opened") + F.col("__pos") - F.col("__joins")).alias("line_no"),
        nfkc(F.concat("text", F.coalesce(rest, F.lit("")))).alias("text"),
    )


def _bucket_lines(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per bucket: lines opened before it, whether its first piece joins one of them (0 or 1), what later buckets add to its last line."""
    ends = buckets.select(
        *keys, "__part", F.size("__pieces").alias("__n"), F.get("__pieces", F.lit(0)).alias("__text"), "__first_y", "__last_y", F.lit(1).alias("__any")
    )
    run = F.floor(F.col("__part") / FAN)
    seen = previous_values(ends, keys, "__part", run, {"__before_y": "__last_y", "__before": "__any"}, FAN)
    # As inside a bucket, only two known and different y part lines.
    parted = F.coalesce(F.col("__before_y") != F.col("__first_y"), F.lit(False))
    joins = (F.col("__before").isNotNull() & ~parted).cast("int")
    told = seen.select(*keys, "__part", "__text", joins.alias("__joins"), (F.col("__n") - joins).alias("__opens"))
    told = told.withColumn("__text", F.when(F.col("__joins") == 1, F.col("__text")))
    numbered = earlier_totals(told, keys, "__part", "__opens", "__opened", FAN)
    last = [*keys, "__line"]
    pieces = numbered.filter("__joins = 1").withColumn("__line", F.col("__opened") - 1).groupBy(*last)
    rests = pieces.agg(F.array_join(F.array_sort(F.collect_list(F.struct("__part", "__text")))["__text"], "").alias("__rest"))
    # A bucket without a line of its own has nothing to be continued.
    line = F.when(F.col("__opens") > 0, F.col("__opened") + F.col("__opens") - 1)
    known = numbered.select(*keys, "__part", "__joins", "__opened", line.alias("__line"))
    return known.join(rests, last, "left").select(*keys, "__part", "__joins", "__opened", "__rest")


def page_texts(lines: DataFrame, keys: Sequence[str] = ("file_id", "page")) -> DataFrame:
    """Lines of a page as one text, the form the text layout reads."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def regroup_lines(
    lines: DataFrame, keys: Sequence[str], line_no: str, is_start: Column, out: str, bucket: Column | None = None
) -> DataFrame:
    """Number the records of a line table: a start line opens one, other lines continue it.

    Lines before the first start are dropped.
    """
    by = F.floor(F.col(line_no) / ITEMS_PER_BUCKET) if bucket is None else bucket
    counted = running_count(lines, keys, [line_no], by, is_start, out)
    return counted.filter(F.col(out) > 0).withColumn(out, F.col(out) - 1)
