"""Search, lookup and enrichment of the master tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import design_fee, fee_unbid
from ..functions.text import BLANK_CHARS, blank_to_null, trim_wide
from ..schemas import PROJECT_FIELDS, schema_of


def _contains(q: str | None, *columns: str) -> Column | None:
    # % and _ match any text; a backslash is an ordinary character
    text = (q or "").strip(BLANK_CHARS).replace("\\", "\\\\")
    if not text:
        return None
    hit = F.col(columns[0]).ilike(f"%{text}%")
    for name in columns[1:]:
        hit = hit | F.col(name).ilike(f"%{text}%")
    return hit


def search_by_name(table: DataFrame, q: str | None, fields: Sequence[str]) -> DataFrame:
    """Case-insensitive contains on the name, sorted by name; no text means all rows."""
    hit = _contains(q, "name")
    return (table if hit is None else table.filter(hit)).select(*fields).orderBy("name")


def with_fees(projects: DataFrame) -> DataFrame:
    fee = design_fee("design_fee_type", "design_fee_amount", "award_amount", "design_fee_pct")
    return projects.select(
        "*",
        fee.alias("design_fee_actual"),
        fee_unbid("design_fee_type", "award_amount").alias("design_fee_unbid"),
    )


def search_projects(projects: DataFrame, q: str | None) -> DataFrame:
    """Match name or project number, newest first, with the computed fee."""
    hit = _contains(q, "name", "project_no")
    return with_fees(projects if hit is None else projects.filter(hit)).orderBy(F.desc("id"))


def lookup_by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a batch of ids."""
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def fee_display(projects: DataFrame) -> DataFrame:
    """Fee as shown to people: not tendered, an amount with separators, or a dash."""
    actual = F.col("design_fee_actual")
    places = F.format_number(F.round(actual, 3), 3)
    trimmed = F.regexp_replace(places, r"\.?0+$", "")
    text = (
        F.when(F.col("design_fee_unbid"), F.lit("未招標,待補"))
        .when(actual.isNotNull(), F.concat(trimmed, F.lit(" 元")))
        .otherwise(F.lit("—"))
    )
    return with_fees(projects).select("id", "project_no", "name", text.alias("fee_text"))


# Labels of states and kinds of submissions.
STATUS_LABELS = {"submitted": "已繳", "overdue": "未繳", "pending": "未到期"}
TYPE_LABELS = {"supervision": "督導", "monthly": "每月"}


def status_display(grid: DataFrame) -> DataFrame:
    label = F.lit("")
    for state, text in STATUS_LABELS.items():
        label = F.when(F.col("status") == state, F.lit(text)).otherwise(label)
    return grid.withColumn("status_label", label)


def ledger_display(ledger: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "supervision", TYPE_LABELS["supervision"]).otherwise(TYPE_LABELS["monthly"])
    return ledger.withColumns({"type_label": kind, "period_text": F.coalesce("period", F.lit("—"))})


def normalized_projects(raw: DataFrame) -> DataFrame:
    """All project fields: empty text becomes null, and so does a field that is absent."""
    kept = [c for c in raw.columns if c not in PROJECT_FIELDS]
    texts = {f.name for f in raw.schema.fields if f.dataType.simpleString() == "string"}
    types = {f.name: f.dataType for f in schema_of("projects").fields}

    def field(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast(types[name]).alias(name)
        return blank_to_null(name).alias(name) if name in texts else F.col(name)

    return raw.select(*kept, *[field(c) for c in PROJECT_FIELDS])


def single_primary(children: DataFrame, parent: str, pos: str) -> DataFrame:
    """Clear every primary flag but the first of each parent.

    The first flagged place is an aggregate per parent (combined map-side), joined back,
    so a parent with very many children is never one task's window.
    """
    flagged = F.coalesce(F.col("is_primary"), F.lit(False))
    first = children.filter(flagged).groupBy(parent).agg(F.min(pos).alias("__first"))
    joined = children.join(first, parent, "left")
    keep = F.coalesce(flagged & (F.col(pos) == F.col("__first")), F.lit(False))
    return joined.withColumn("is_primary", keep).drop("__first")


def clean_contacts(children: DataFrame) -> DataFrame:
    """Empty contact text becomes null and an absent flag becomes false."""
    fields = ["name", "phone", "email", "line_id"]
    cleaned = {c: blank_to_null(c) for c in fields if c in children.columns}
    return children.withColumns(cleaned | {"is_primary": F.coalesce(F.col("is_primary"), F.lit(False))})


def named_children(children: DataFrame) -> DataFrame:
    """Children whose trimmed name is not empty."""
    return children.withColumn("name", trim_wide("name")).filter(F.col("name") != "")


def import_names(lines: DataFrame, order: Sequence[str], existing: DataFrame) -> DataFrame:
    """First place of each new name: order-preserving dedupe, then a set difference.

    ``lines`` has a name per row and its place in ``order``; ``existing`` has a name column.
    """
    first = lines.groupBy("name").agg(F.min(F.struct(*order)).alias("__at"))
    fresh = first.join(existing.select("name").distinct(), "name", "left_anti")
    return fresh.select("name", *[F.col(f"__at.{c}").alias(c) for c in order])


def import_totals(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """Names created, and lines skipped as repeats or as already present."""
    counted = lines.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    known = existing.select("name").distinct().withColumn("__known", F.lit(True))
    marked = counted.join(known, "name", "left")
    created = F.count_if(F.col("__known").isNull())
    total = F.coalesce(F.sum("n"), F.lit(0))
    return marked.agg(created.alias("created"), (total - created).alias("skipped"))


def with_names(rows: DataFrame, table: DataFrame, key: str, out: str) -> DataFrame:
    """Adds the name of the row of ``table`` that the column ``key`` points at, null if there is none.

    Rows without a key match nothing; each gets a key of its own below zero, so that they
    are spread over the tasks of the join instead of meeting in one.
    """
    names = table.select(F.col("id").alias("__id"), F.col("name").alias(out))
    own = -1 - F.pmod(F.xxhash64("id"), F.lit(2**62))
    return rows.join(names, F.coalesce(F.col(key).cast("bigint"), own) == F.col("__id"), "left").drop("__id")


def project_wide(
    projects: DataFrame, vendors: DataFrame, schools: DataFrame, insurers: DataFrame, types: DataFrame
) -> DataFrame:
    """Projects with the names of vendor, school, insurer and the insurer's own type."""
    named = with_names(projects, vendors, "vendor_id", "vendor_name")
    named = with_names(named, schools, "school_id", "school_name")
    named = with_names(named, insurers, "insurer_id", "insurer_name")
    own = types.select("insurer_id", F.col("id").alias("insurance_type_id"), F.col("name").alias("insurance_type_name"))
    return named.join(own, ["insurer_id", "insurance_type_id"], "left")


def project_vendors(projects: DataFrame, vendors: DataFrame) -> DataFrame:
    return with_names(projects, vendors, "vendor_id", "vendor_name")


def submission_history(ledger: DataFrame) -> DataFrame:
    """All columns of the ledger by period, records without one last."""
    return ledger.orderBy(F.asc_nulls_last("period"), "id")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and emptiness of each table."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.withColumn("is_empty", F.col("n") == 0)


def authorized_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with a flag that tells whether their user is an administrator."""
    roles = users.select(F.col("id").alias("user_id"), (F.col("role") == "admin").alias("__admin"))
    joined = requests.join(roles, "user_id", "left")
    return joined.withColumn("authorized", F.coalesce("__admin", F.lit(False))).drop("__admin")
