"""Checks that follow from keys, constraints and the arithmetic of the logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..functions.text import trim_wide
from .ranking import previous_values

# Foreign keys as (child table, column, parent table).
FOREIGN_KEYS = [
    ("vendor_contacts", "vendor_id", "vendors"),
    ("school_contacts", "school_id", "schools"),
    ("insurance_types", "insurer_id", "insurers"),
    ("projects", "vendor_id", "vendors"),
    ("projects", "school_id", "schools"),
    ("projects", "insurer_id", "insurers"),
    ("projects", "insurance_type_id", "insurance_types"),
    ("submission_history", "project_id", "projects"),
]

# Columns that must be unique, and names that must not be blank.
UNIQUE = [("users", "username"), ("settings", "key")]
NAMED = ["vendors", "schools", "insurers", "insurance_types", "projects"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, value, n) of keys that point nowhere, one row per missing key.

    References are counted per key before the join, so a key shared by very many rows
    reaches the join as one row.
    """
    parts = []
    for child, column, parent in FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        used = tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id"))
        counted = used.agg(F.count(F.lit(1)).alias("n"))
        missing = counted.join(tables[parent].select("id"), "id", "left_anti")
        parts.append(missing.select(F.lit(child).alias("table_name"), F.lit(column).alias("column_name"), F.col("id").alias("value"), "n"))
    return _union(parts)


def key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, rule, value, n) of blank names and repeated unique values."""
    parts = []
    for name in NAMED:
        if name in tables:
            blank = tables[name].filter(F.coalesce(trim_wide("name"), F.lit("")) == "")
            parts.append(
                blank.groupBy(F.col("name").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
                    F.lit(name).alias("table_name"), F.lit("name").alias("column_name"),
                    F.lit("blank").alias("rule"), "value", "n",
                )
            )
    for name, column in UNIQUE:
        if name in tables:
            repeated = tables[name].groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(
                repeated.filter("n > 1").select(
                    F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
                    F.lit("repeated").alias("rule"), "value", "n",
                )
            )
    return _union(parts)


def type_mismatch(projects: DataFrame, types: DataFrame) -> DataFrame:
    """Projects whose insurance type belongs to another insurer."""
    owner = types.select(F.col("id").alias("insurance_type_id"), F.col("insurer_id").alias("type_insurer_id"))
    joined = projects.join(owner, "insurance_type_id")
    wrong = joined.filter(~F.col("insurer_id").eqNullSafe(F.col("type_insurer_id")))
    return wrong.select(F.col("id").alias("project_id"), "insurer_id", "insurance_type_id", "type_insurer_id")


def amount_mismatch(items: DataFrame) -> DataFrame:
    """Items whose amount is not price times quantity to two places."""
    expected = round_half_up(F.col("unit_price") * F.col("today_qty"), 2)
    checked = items.withColumn("expected_amount", expected)
    return checked.filter(F.abs(F.col("today_amount") - F.col("expected_amount")) >= 0.005)


def falling_totals(rows: DataFrame, keys: list[str], values: Sequence[str], days_per_bucket: int = 4096) -> DataFrame:
    """Rows where some cumulative value is below that of the day before, per key.

    All values are looked at in one pass; each has a column previous_<value>, and
    ``falling`` names those that fell.
    """
    bucket = F.floor(F.col("day_pos") / days_per_bucket)
    seen = previous_values(rows, keys, "day_pos", bucket, {f"previous_{v}": v for v in values})
    fell = F.array_compact(F.array(*[F.when(F.col(v) < F.col(f"previous_{v}"), F.lit(v)) for v in values]))
    return seen.withColumn("falling", fell).filter(F.size("falling") > 0)


def file_consistency(days: DataFrame, items: DataFrame) -> DataFrame:
    """Per file: distinct project names, smallest and largest item count of a day, and whether both are one."""
    names = days.groupBy("file_id").agg(F.countDistinct("project_name").alias("n_names"), F.count(F.lit(1)).alias("n_days"))
    per_day = items.groupBy("file_id", "day_pos").agg(F.count(F.lit(1)).alias("n"))
    counts = per_day.groupBy("file_id").agg(F.min("n").alias("min_items"), F.max("n").alias("max_items"))
    joined = names.join(counts, "file_id", "left")
    ok = (F.col("n_names") == 1) & F.coalesce(F.col("min_items") == F.col("max_items"), F.lit(False))
    return joined.withColumn("consistent", ok)
