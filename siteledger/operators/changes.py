"""Batches of inserts, updates, replacements and deletes as table-to-table jobs."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_inside_root, trim_wide
from ..schemas import table_exists
from .masters import clean_contacts, named_children, single_primary
from .ranking import latest

# The message shown when a required name is missing, per table.
NAME_REQUIRED = {
    "vendors": "廠商名稱為必填",
    "schools": "學校名稱為必填",
    "insurers": "保險公司名稱為必填",
    "projects": "工程名稱為必填",
}

PATH_COLUMNS = ["daily_log_path", "official_doc_path", "report_path"]


def intake_named(rows: DataFrame, table: str) -> DataFrame:
    """Trim the name; rows without one carry an error instead of being accepted."""
    named = rows.withColumn("name", trim_wide(F.coalesce("name", F.lit(""))))
    missing = F.col("name") == ""
    return named.withColumn("accepted", ~missing).withColumn("error", F.when(missing, F.lit(NAME_REQUIRED[table])))


def _has_name() -> Column:
    return trim_wide(F.coalesce("name", F.lit(""))) != ""


def _with_name(changes: DataFrame) -> DataFrame:
    return changes.filter(_has_name()) if "name" in changes.columns else changes


def refused_updates(changes: DataFrame, table: str) -> DataFrame:
    """Changes whose name is blank, with the message that tells so."""
    return changes.filter(~_has_name()).withColumn("error", F.lit(NAME_REQUIRED[table]))


def apply_updates(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Full-row updates by key; the last change of a key wins, unknown keys change nothing.

    Where rows have a name, a change without one is refused and changes nothing.
    """
    last = latest(_with_name(changes), [key], [seq]).drop(seq)
    untouched = base.join(last.select(key), key, "left_anti")
    known = last.join(base.select(key), key, "left_semi")
    return untouched.unionByName(known.select(*base.columns))


def unknown_updates(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes whose key does not exist; they are reported, not applied."""
    return changes.join(base.select(key), key, "left_anti")


def replace_children(children: DataFrame, replaced: DataFrame, fresh: DataFrame, parent: str, pos: str) -> DataFrame:
    """Drop all children of the replaced parents, then add the new ones.

    New children without a name are left out. Contacts are cleaned and have one primary
    per parent; children without such a flag (insurance types) are taken as they are.
    """
    kept = children.join(replaced.select(parent).distinct(), parent, "left_anti")
    named = named_children(fresh)
    if "is_primary" in children.columns:
        named = single_primary(clean_contacts(named), parent, pos)
    return kept.unionByName(named.select(*children.columns))


def refused_deletes(gone: DataFrame, references: Sequence[tuple[DataFrame, str]], gone_key: str = "id") -> DataFrame:
    """The ids among ``gone`` that other rows still name: (table, column) pairs that block a delete."""
    used = [table.select(F.col(column).alias(gone_key)).filter(F.col(gone_key).isNotNull()).distinct() for table, column in references]
    named = functools.reduce(DataFrame.unionByName, used).distinct()
    return gone.select(gone_key).distinct().join(named, gone_key, "left_semi")


def delete_unreferenced(table: DataFrame, gone: DataFrame, references: Sequence[tuple[DataFrame, str]], key: str = "id") -> DataFrame:
    """The table without the deleted ids, except those that a delete is refused for."""
    free = gone.select(key).distinct().join(refused_deletes(gone, references, key), key, "left_anti")
    return delete_rows(table, free, key, key)


def delete_rows(table: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """Rows of a table whose key is not among the deleted ids; used for parent and children."""
    ids = gone.select(F.col(gone_key).alias(key)).distinct()
    return table.join(ids, key, "left_anti")


def merge_changes(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Updates and deletes of one change log (op 'update' or 'delete'); a delete of a key stands."""
    deleted = changes.filter(F.col("op") == "delete")
    updates = changes.filter(F.col("op") == "update").drop("op")
    return delete_rows(apply_updates(base, updates, key, seq), deleted, key, key)


def backfill_reports(ledger: DataFrame, generated: DataFrame) -> DataFrame:
    """Set report_path of the submissions whose report was generated: (id, report_path)."""
    new = generated.select("id", F.col("report_path").alias("__new"))
    return ledger.join(new, "id", "left").withColumn("report_path", F.coalesce("__new", "report_path")).drop("__new")


def stored_paths(ledger: DataFrame) -> DataFrame:
    """One row per stored path with a flag that tells whether it may be touched."""
    pairs = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("path")) for c in PATH_COLUMNS]
    rows = ledger.select("id", F.explode(F.array(*pairs)).alias("p")).select("id", "p.kind", "p.path")
    return rows.filter(F.col("path") != "").withColumn("safe", is_inside_root("path"))


def deletion_plan(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """Files to remove with the deleted submissions; paths outside the root are left out."""
    doomed = ledger.join(gone.select("id").distinct(), "id", "left_semi")
    return stored_paths(doomed).filter("safe").select("id", "kind", "path")


def append_rows(df: DataFrame, path: str, key: Sequence[str] = ("id",)) -> None:
    """Append the rows whose key the stored table does not hold yet; appending the same rows again adds nothing."""
    spark = df.sparkSession
    rows = df
    if table_exists(spark, path):
        stored = spark.read.schema(df.schema).parquet(path).select(*key)
        rows = df.join(stored, list(key), "left_anti").select(*df.columns)
    rows.write.mode("append").parquet(path)
