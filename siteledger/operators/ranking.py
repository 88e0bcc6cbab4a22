"""Ordered counting that survives one huge group.

A plain window sends a whole group to one task. Here the caller names a ``bucket``
that grows with the order (for example ``line_no div 4096``). Buckets are summed
first, the small table of bucket totals gets a running sum per group, and the exact
window runs inside each bucket only. The result equals the plain window. Keys and
bucket must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET = "__bucket"
COPY_STEP = 16_384


#: Buckets whose totals one task adds up; totals of many more buckets go through a second level.
FAN = 4096


def earlier_totals(totals: DataFrame, keys: Sequence[str], bucket: str, total: str, out: str, fan: int | None) -> DataFrame:
    """Adds to each bucket the sum of its group's earlier buckets.

    With ``fan`` (for numeric buckets) runs of so many bucket numbers are summed first, so
    that a group with any number of buckets is never one task's work: one task sees either
    the buckets of one run or one row per run.
    """
    if fan is None:
        before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
        return totals.withColumn(out, F.coalesce(F.sum(total).over(before), F.lit(0)))
    runs = totals.withColumn("__run", F.floor(F.col(bucket) / fan))
    per_run = runs.groupBy(*keys, "__run").agg(F.sum(total).alias("__sum"))
    per_run = earlier_totals(per_run, keys, "__run", "__sum", "__runs_before", None).drop("__sum")
    within = earlier_totals(runs, [*keys, "__run"], bucket, total, "__within", None)
    joined = within.join(per_run, [*keys, "__run"])
    return joined.withColumn(out, F.col("__within") + F.col("__runs_before")).drop("__within", "__runs_before", "__run")


def _with_offsets(
    base: DataFrame, inner: DataFrame, keys: Sequence[str], bucket: str, total: Column, local: str, out: str, fan: int | None = None
) -> DataFrame:
    """Add the totals of earlier buckets to a count made inside each bucket."""
    totals = base.groupBy(*keys, bucket).agg(total.alias("__total"))
    offsets = earlier_totals(totals, keys, bucket, "__total", "__offset", fan).drop("__total")
    joined = inner.join(offsets, [*keys, bucket])
    return joined.withColumn(out, F.col(local) + F.col("__offset")).drop("__offset", local)


@dataclass(frozen=True)
class Place:
    """A position to compute: within which keys, in which order, spread over which buckets.

    With ``weight`` a row stands for that many equal rows and gets the place of the first.
    """

    keys: Sequence[str]
    order: Sequence[Column | str]
    bucket: Column
    weight: str | None = None


def positions_of(df: DataFrame, places: dict[str, Place]) -> DataFrame:
    """0-based positions of each row within several groupings.

    Bucket totals are all taken from the input itself, so the input is read once more per
    grouping; chaining single calls would double the reads with every call.
    """
    buckets = {name: f"{BUCKET}_{name}" for name in places}
    base = df.withColumns({buckets[name]: place.bucket for name, place in places.items()})
    # Stated here, the condition reaches both readings alike, so Spark can share a shuffle.
    for column in dict.fromkeys([*buckets.values(), *[k for place in places.values() for k in place.keys]]):
        base = base.filter(F.col(column).isNotNull())
    out = base
    for name, place in places.items():
        inside = W.partitionBy(*place.keys, buckets[name]).orderBy(*place.order)
        if place.weight is None:
            local, total = F.row_number().over(inside) - 1, F.count(F.lit(1))
        else:
            earlier = inside.rowsBetween(W.unboundedPreceding, -1)
            local, total = F.coalesce(F.sum(place.weight).over(earlier), F.lit(0)), F.sum(place.weight)
        inner = out.withColumn("__local", local)
        out = _with_offsets(base, inner, place.keys, buckets[name], total, "__local", name)
    return out.drop(*buckets.values())


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, out: str) -> DataFrame:
    """0-based position of each row within its group."""
    return positions_of(df, {out: Place(keys, order, bucket)})


def positions_of_copies(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str
) -> DataFrame:
    """Positions where rows may be copies of each other, however many.

    ``keys`` and ``order`` must be all columns. Equal rows collapse to one counted row
    before the first shuffle, the counted rows are placed, and each is then written out
    again as often as it occurred. No window ever holds the copies.
    """
    counted = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("__n"))
    placed = positions_of(counted, {"__start": Place(keys, order, bucket, "__n")})
    # Two steps keep the generated arrays short.
    steps = placed.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(COPY_STEP))))
    last = F.least(F.col("__from") + (COPY_STEP - 1), F.col("__n") - 1)
    each = steps.withColumn("__nth", F.explode(F.sequence(F.col("__from"), last)))
    return each.withColumn(out, F.col("__start") + F.col("__nth")).drop("__n", "__start", "__from", "__nth")


@dataclass(frozen=True)
class Spread:
    """How the rows of a table fall on the cells of a hash of one key, told by :func:`spread_of`."""

    key: str
    rows: int
    crowded: tuple[int, ...]
    partitions: int

    def near(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """The rows of all keys outside crowded cells; ``key`` is the key's name in ``df``, if another."""
        return df.filter(~_cell_of(key or self.key).isin(list(self.crowded))) if self.crowded else df

    def gathered(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """The rows of all keys outside crowded cells, each key in one task; later groupings by key and more need no shuffle."""
        return self.near(df, key).repartition(self.partitions, key or self.key)

    def apart(self, df: DataFrame, key: str | None = None) -> DataFrame | None:
        """The other rows, for a way that spreads a key over tasks; None if there are none."""
        return df.filter(_cell_of(key or self.key).isin(list(self.crowded))) if self.crowded else None


#: Cells that keys are hashed to, and rows of a cell (or times the mean) from which its keys are not gathered.
CELLS = 65_536
CROWDED_ROWS = 400_000
CROWDED_TIMES = 8
#: Rows gathered in a task, at most where no cell holds more; a small table is dealt to fewer tasks than the session's.
TASK_ROWS = 30_000
LEAST_ROWS = 5_000


def _cell_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def spread_of(df: DataFrame, key: str, crowded_rows: int = CROWDED_ROWS) -> Spread:
    """Count the rows per cell of ``key``: one pass over that column, combined map-side to one row per cell."""
    counts = df.groupBy(_cell_of(key).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.collect_list(F.struct("cell", "n")).alias("cells"))
    limit = F.greatest(F.lit(crowded_rows), F.col("rows") * CROWDED_TIMES / CELLS)
    found = total.select("rows", F.transform(F.filter("cells", lambda c: c["n"] > limit), lambda c: c["cell"]).alias("crowded")).first()
    wished = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(-(-found["rows"] // TASK_ROWS), min(wished, -(-found["rows"] // LEAST_ROWS)), 1)
    return Spread(key, found["rows"], tuple(sorted(found["crowded"])), partitions)


def running_count(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, flag: Column, out: str, fan: int | None = None
) -> DataFrame:
    """Number of flagged rows up to and including each row; ``fan`` as for the totals of buckets."""
    base = df.withColumn(BUCKET, bucket).withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("bigint"))
    inside = W.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = base.withColumn("__local", F.sum("__flag").over(inside)).drop("__flag")
    return _with_offsets(base, inner, keys, BUCKET, F.sum("__flag"), "__local", out, fan).drop(BUCKET)


def _last_before(tails: DataFrame, keys: Sequence[str], bucket: str, fan: int | None) -> DataFrame:
    """Replaces ``__tail`` by that of the group's bucket before; runs of buckets as for totals."""
    if fan is None:
        return tails.withColumn("__tail", F.lag("__tail").over(W.partitionBy(*keys).orderBy(bucket)))
    runs = tails.withColumn("__run", F.floor(F.col(bucket) / fan))
    per_run = runs.groupBy(*keys, "__run").agg(F.max_by("__tail", bucket).alias("__tail"))
    per_run = _last_before(per_run, keys, "__run", None).withColumnRenamed("__tail", "__run_before")
    inside = W.partitionBy(*keys, "__run").orderBy(bucket)
    within = runs.withColumns({"__opens": F.row_number().over(inside) == 1, "__before": F.lag("__tail").over(inside)})
    joined = within.join(per_run, [*keys, "__run"])
    tail = F.when(F.col("__opens"), F.col("__run_before")).otherwise(F.col("__before"))
    return joined.withColumn("__tail", tail).drop("__run", "__opens", "__before", "__run_before")


def previous_values(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, values: dict[str, str], fan: int | None = None
) -> DataFrame:
    """The values of the row before, also across a bucket border; null for the first row.

    ``values`` maps new columns to the columns they are taken from. All of them travel
    together: one window inside the buckets, and one row per bucket that carries the last
    values of all.
    """
    base = df.withColumn(BUCKET, bucket)
    inside = W.partitionBy(*keys, BUCKET).orderBy(order)
    held = F.struct(*[F.col(v).alias(o) for o, v in values.items()])
    inner = base.withColumns({"__local": F.lag(held).over(inside), "__first": F.row_number().over(inside) == 1})
    tails = base.groupBy(*keys, BUCKET).agg(F.max_by(held, order).alias("__tail"))
    joined = inner.join(_last_before(tails, keys, BUCKET, fan), [*keys, BUCKET])
    chosen = F.when(F.col("__first"), F.col("__tail")).otherwise(F.col("__local"))
    joined = joined.withColumn("__local", chosen)
    return joined.withColumns({o: F.col(f"__local.{o}") for o in values}).drop(BUCKET, "__local", "__first", "__tail")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, value: str, out: str, fan: int | None = None
) -> DataFrame:
    """One value of the row before."""
    return previous_values(df, keys, order, bucket, {out: value}, fan)


def nested_positions(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, within: dict[str, Sequence[str]]) -> DataFrame:
    """0-based positions of each row, by one order, within several nested groupings at once.

    ``within`` maps each new column to the columns that divide its group further (none for
    the position within ``keys`` alone). All groupings share one partitioning by (keys,
    bucket). The totals of all of them come from one aggregate; those of earlier buckets
    enter each bucket as leading rows with a number of their own, so that a running sum
    over the bucket gives the position and nothing is joined. Two shuffles for the totals,
    one for the rows, however many groupings there are.
    """
    fine = list(dict.fromkeys(c for columns in within.values() for c in columns))
    base = df.withColumn(BUCKET, bucket)
    # Groups may be divided by null values; keys and bucket are never null.
    totals = base.groupBy(*keys, BUCKET, *fine).agg(F.count(F.lit(1)).alias("__n")).repartition(*keys)
    for out, columns in within.items():
        earlier = W.partitionBy(*keys, *columns).orderBy(BUCKET).rangeBetween(W.unboundedPreceding, -1)
        # One leading row of each group and bucket carries the sum, the others carry none.
        leads = F.row_number().over(W.partitionBy(*keys, *columns, BUCKET).orderBy(*fine)) == 1
        totals = totals.withColumn(out, F.when(leads, F.coalesce(F.sum("__n").over(earlier), F.lit(0))).otherwise(0))
    row = F.struct(*[F.col(c) for c in df.columns]).alias("__row")
    lead = totals.select(*keys, BUCKET, *fine, F.lit(False).alias("__own"), F.lit(None).cast(df.schema[order].dataType).alias("__order"), *within)
    own = base.select(*keys, BUCKET, *fine, F.lit(True).alias("__own"), F.col(order).alias("__order"), *[F.lit(1).cast("bigint").alias(o) for o in within], row)
    both = own.unionByName(lead, allowMissingColumns=True).repartition(*keys, BUCKET)
    for out, columns in within.items():
        until = W.partitionBy(*keys, BUCKET, *columns).orderBy("__own", "__order").rowsBetween(W.unboundedPreceding, W.currentRow)
        both = both.withColumn(out, F.sum(out).over(until) - 1)
    return both.filter("__own").select("__row.*", *within)


def latest(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Last row per key by sequence, as an aggregate so that a hot key combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*seq)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
