"""Children as ordered arrays under their parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import positions

PAGE_SIZE = 1000


def nest_children(
    parents: DataFrame,
    children: DataFrame,
    keys: dict[str, str],
    order: str,
    fields: Sequence[str],
    out: str,
    bucket: Column | None = None,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Left nest of children; parents without children get an empty array.

    ``keys`` maps parent columns to child columns. Up to ``page_size`` children a parent
    is one row with ``page`` 0. A larger family continues on further rows (``page`` 1,
    2, …), so no array grows without bound and no child is lost.
    """
    names = list(keys)
    owned = children
    for parent, child in keys.items():
        owned = owned.filter(F.col(child).isNotNull())
        if parent != child:
            owned = owned.withColumn("__" + parent, F.col(child))
    owned = owned.select(
        *[F.col(p if p == c else "__" + p).alias("__key_" + p) for p, c in keys.items()],
        F.col(order).alias("__order"),
        F.struct(*fields).alias("__child"),
    )
    group = ["__key_" + p for p in names]
    by = F.floor(F.col("__order") / 2**20) if bucket is None else bucket
    ranked = positions(owned, group, ["__order"], by, "__pos")
    paged = ranked.withColumn("page", F.floor(F.col("__pos") / page_size).cast("int"))
    entry = F.struct("__pos", "__child")
    arrays = paged.groupBy(*group, "page").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["__child"]).alias(out)
    )
    condition = [parents[p] == arrays["__key_" + p] for p in names]
    joined = parents.join(arrays, condition, "left")
    empty = F.array().cast(arrays.schema[out].dataType)
    return joined.select(
        *[parents[c] for c in parents.columns],
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce(out, empty).alias(out),
    )


def nest_kinds(
    parents: DataFrame,
    keys: Sequence[str],
    parent_fields: Sequence[str],
    kinds: dict[str, tuple[DataFrame, str, Sequence[str]]],
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Children of several kinds under their parents, all by one aggregate.

    ``kinds`` maps each array to (table, position column, fields). Parents and children
    are one union, tagged by kind, so a parent costs no join however many kinds there
    are. Positions count from 0; those from ``page_size`` on go to further rows (``page``
    1, 2, …), which carry the keys and no parent fields, so no array grows without bound.
    Page 0 of a family without a parent row is left out.
    """
    parent = F.struct(*parent_fields)
    tagged = parents.select(*keys, F.lit(0).alias("page"), F.struct(parent.alias("p")).alias("__parent"))
    for out, (table, pos, fields) in kinds.items():
        place = F.col(pos).cast("bigint")
        child = F.struct(place.alias("pos"), F.struct(*fields).alias("child")).alias(f"__{out}")
        rows = table.select(*keys, F.floor(place / page_size).cast("int").alias("page"), child)
        tagged = tagged.unionByName(rows, allowMissingColumns=True)
    arrays = [F.array_sort(F.collect_list(f"__{out}")).alias(f"__{out}") for out in kinds]
    nested = tagged.groupBy(*keys, "page").agg(F.first("__parent", ignorenulls=True).alias("__parent"), *arrays)
    known = nested.filter((F.col("page") > 0) | F.col("__parent").isNotNull())
    shown = [F.transform(f"__{out}", lambda e: e["child"]).alias(out) for out in kinds]
    return known.select(*keys, "page", *[F.col(f"__parent.p.{f}").alias(f) for f in parent_fields], *shown)
