"""Master data, status grid, changes and checks."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import base_month
from ..operators import changes, masters, quality
from ..operators.nesting import nest_children
from ..operators.ranking import latest
from ..plans import status
from ..session import shared_folder
from ..sources import lists, stored
from ..sources.star_views import AS_OF
from .registry import query

AS_OF_DAY = "1996-06-03"


# Status grid -----------------------------------------------------------------


@query(
    "submission_status",
    f"""
    WITH spine AS (
        SELECT id AS project_id, strftime(m, '%Y-%m') AS period
        FROM v_projects, unnest(generate_series(date_trunc('month', start_date), TIMESTAMP '1996-06-01', INTERVAL 1 MONTH)) AS t(m)),
    done AS (SELECT DISTINCT project_id, period FROM v_ledger WHERE type = 'monthly')
    SELECT s.project_id, s.period, s.period || '-05' AS deadline,
           CASE WHEN d.period IS NOT NULL THEN 'submitted'
                WHEN s.period || '-05' <= '{AS_OF_DAY}' THEN 'overdue' ELSE 'pending' END AS status
    FROM spine s LEFT JOIN done d ON d.project_id = s.project_id AND d.period = s.period""",
)
def submission_status(v):
    return status.submission_status(v.projects, v.ledger, v.default_settings, AS_OF)


@query(
    "period_spine",
    """
    SELECT id AS project_id, strftime(m, '%Y-%m') AS period
    FROM v_projects, unnest(generate_series(date_trunc('month', start_date), TIMESTAMP '1996-06-01', INTERVAL 1 MONTH)) AS t(m)""",
)
def period_spine(v):
    return status.period_spine(v.projects, AS_OF)


@query(
    "status_display",
    f"""
    WITH spine AS (
        SELECT id AS project_id, strftime(m, '%Y-%m') AS period
        FROM v_projects, unnest(generate_series(date_trunc('month', start_date), TIMESTAMP '1996-06-01', INTERVAL 1 MONTH)) AS t(m)),
    done AS (SELECT DISTINCT project_id, period FROM v_ledger WHERE type = 'monthly')
    SELECT s.project_id, s.period,
           CASE WHEN d.period IS NOT NULL THEN '已繳' WHEN s.period || '-05' <= '{AS_OF_DAY}' THEN '未繳' ELSE '未到期' END AS status_label
    FROM spine s LEFT JOIN done d ON d.project_id = s.project_id AND d.period = s.period""",
)
def status_display(v):
    return masters.status_display(submission_status(v)).select("project_id", "period", "status_label")


@query("submission_history", "SELECT * FROM v_ledger")
def submission_history(v):
    return masters.submission_history(v.ledger)


@query(
    "submitted_months",
    """
    SELECT project_id, count(DISTINCT period) AS n_months, min(period) AS first_period
    FROM v_ledger WHERE type = 'monthly' GROUP BY project_id""",
)
def submitted_months(v):
    months = status.submitted_months(v.ledger).distinct()
    counted = months.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_months"), F.min("month").alias("first"))
    return counted.select("project_id", "n_months", status.period_text(F.col("first")).alias("first_period"))


@query(
    "fn_base_month",
    """
    SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN '1996-06'
                    WHEN id % 3 = 0 THEN strftime(created_at, '%Y-%m')
                    ELSE strftime(start_date, '%Y-%m') END AS period
    FROM v_projects""",
)
def fn_base_month(v):
    start = F.when(F.col("id") % 3 != 0, F.col("start_date"))
    created = F.when(F.col("id") % 2 != 0, F.col("created_at"))
    return v.projects.select("id", base_month(start, created, AS_OF).alias("period"))


# Search and lookup -----------------------------------------------------------


@query("vendor_search", "SELECT id, name, created_at FROM v_vendors WHERE name ILIKE '%#00000000%'")
def vendor_search(v):
    return masters.search_by_name(v.vendors, " #00000000 ", ["id", "name", "created_at"])


@query("school_search", "SELECT id, name, county FROM v_schools WHERE name ILIKE '%CUSTOMER#%7%'")
def school_search(v):
    return masters.search_by_name(v.schools, "CUSTOMER#%7", ["id", "name", "county"])


@query("insurer_search", "SELECT id, name FROM v_insurers WHERE name ILIKE '%a%'")
def insurer_search(v):
    return masters.search_by_name(v.insurers, "A", ["id", "name"])


@query(
    "project_search",
    """
    SELECT id, project_no, name, design_fee_actual, design_fee_unbid FROM v_fees
    WHERE name ILIKE '%99%' OR project_no ILIKE '%99%'""",
)
def project_search(v):
    found = masters.search_projects(v.projects, "99")
    return found.select("id", "project_no", "name", "design_fee_actual", "design_fee_unbid")


@query(
    "lookup_by_ids",
    "SELECT id, name, vendor_id FROM v_projects WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)",
)
def lookup_by_ids(v):
    wanted = v.table("lineitem").filter(F.col("l_quantity") >= 45).select(F.col("l_orderkey").alias("id"))
    return masters.lookup_by_ids(v.projects.select("id", "name", "vendor_id"), wanted)


@query("project_fees", "SELECT id, design_fee_type, award_amount, design_fee_actual, design_fee_unbid FROM v_fees")
def project_fees(v):
    return masters.with_fees(v.projects).select(
        "id", "design_fee_type", "award_amount", "design_fee_actual", "design_fee_unbid"
    )


@query(
    "project_fee_display",
    """
    SELECT id, project_no, name,
           CASE WHEN design_fee_unbid THEN '未招標,待補'
                WHEN design_fee_actual IS NOT NULL THEN format('{:,}', CAST(design_fee_actual AS BIGINT)) || ' 元'
                ELSE '—' END AS fee_text
    FROM v_fees""",
)
def project_fee_display(v):
    return masters.fee_display(v.projects)


@query(
    "status_labels",
    """
    SELECT id, CASE type WHEN 'supervision' THEN '督導' ELSE '每月' END AS type_label, coalesce(period, '—') AS period_text
    FROM v_ledger""",
)
def status_labels(v):
    return masters.ledger_display(v.ledger).select("id", "type_label", "period_text")


@query(
    "project_normalized",
    """
    SELECT id, CASE WHEN id % 2 = 0 THEN project_no END AS project_no, nullif(o.o_orderpriority, '5-LOW') AS name,
           vendor_id, school_id, CAST(start_date AS VARCHAR) AS start_date,
           CASE WHEN id % 3 <> 0 THEN CAST(contract_completion_date AS VARCHAR) END AS contract_completion_date,
           NULL AS actual_completion_date, award_amount, insurer_id, insurance_type_id, NULL AS insurance_start, NULL AS insurance_end,
           CASE WHEN design_fee_type = 'pct' THEN 'pct' END AS design_fee_type, design_fee_amount, design_fee_pct
    FROM v_projects JOIN orders o ON o.o_orderkey = id""",
)
def project_normalized(v):
    priority = v.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    raw = v.projects.join(priority, "id").select(
        "id",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("").alias("name"),
        F.when(F.col("id") % 2 == 0, F.col("project_no")).otherwise("").alias("project_no"),
        "vendor_id", "school_id",
        F.col("start_date").cast("string").alias("start_date"),
        F.when(F.col("id") % 3 != 0, F.col("contract_completion_date").cast("string")).otherwise("").alias("contract_completion_date"),
        "award_amount", "insurer_id", "insurance_type_id",
        F.when(F.col("design_fee_type") == "pct", "pct").otherwise("").alias("design_fee_type"),
        "design_fee_amount", "design_fee_pct",
    )
    return masters.normalized_projects(raw)


@query(
    "project_vendor",
    """
    SELECT p.id, p.vendor_id, v.name AS vendor_name
    FROM v_projects p LEFT JOIN v_vendors v ON v.id = p.vendor_id""",
)
def project_vendor(v):
    return masters.project_vendors(v.projects, v.vendors).select("id", "vendor_id", "vendor_name")


@query(
    "project_wide",
    """
    SELECT p.id, v.name AS vendor_name, s.name AS school_name, i.name AS insurer_name, t.name AS insurance_type_name
    FROM v_projects p LEFT JOIN v_vendors v ON v.id = p.vendor_id
    LEFT JOIN v_schools s ON s.id = p.school_id LEFT JOIN v_insurers i ON i.id = p.insurer_id
    LEFT JOIN v_types t ON t.id = p.insurance_type_id AND t.insurer_id = p.insurer_id""",
)
def project_wide(v):
    wide = masters.project_wide(v.projects, v.vendors, v.schools, v.insurers, v.insurance_types)
    return wide.select("id", "vendor_name", "school_name", "insurer_name", "insurance_type_name")


@query(
    "authorized_requests",
    """
    SELECT o_orderkey AS request_id, o_custkey AS user_id, coalesce(u.role = 'admin', FALSE) AS authorized
    FROM orders LEFT JOIN v_users u ON u.id = o_custkey""",
)
def authorized_requests(v):
    requests = v.table("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"))
    return masters.authorized_requests(requests, v.users)


@query(
    "table_counts",
    """
    SELECT 'vendors' AS table_name, count(*) AS n, count(*) = 0 AS is_empty FROM v_vendors
    UNION ALL SELECT 'schools', count(*), count(*) = 0 FROM v_schools
    UNION ALL SELECT 'projects', count(*), count(*) = 0 FROM v_projects
    UNION ALL SELECT 'submission_history', count(*), count(*) = 0 FROM v_ledger
    UNION ALL SELECT 'users', count(*), count(*) = 0 FROM v_users
    UNION ALL SELECT 'vendor_contacts', count(*), count(*) = 0 FROM v_vendor_contacts
    UNION ALL SELECT 'school_contacts', count(*), count(*) = 0 FROM v_school_contacts
    UNION ALL SELECT 'insurers', count(*), count(*) = 0 FROM v_insurers
    UNION ALL SELECT 'insurance_types', count(*), count(*) = 0 FROM v_types
    UNION ALL SELECT 'settings', count(DISTINCT key), count(*) = 0 FROM v_changes
    WHERE key <> 'settlement_day' OR TRY_CAST(value AS BIGINT) BETWEEN 1 AND 28""",
)
def table_counts(v):
    return masters.table_counts(
        {
            "vendors": v.vendors,
            "schools": v.schools,
            "projects": v.projects,
            "submission_history": v.ledger,
            "users": v.users,
            "vendor_contacts": v.vendor_contacts,
            "school_contacts": v.school_contacts,
            "insurers": v.insurers,
            "insurance_types": v.insurance_types,
            "settings": lists.latest_settings(v.setting_changes),
        }
    )


# Children --------------------------------------------------------------------


def _as_json(df, column):
    return df.withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))


_NESTED = """
    SELECT p.id, p.name, coalesce(c.page, 0) AS page, coalesce(c.kids, '[]') AS {out}
    FROM {parents} p LEFT JOIN (
        SELECT k, page, CAST(to_json(list({fields} ORDER BY id)) AS VARCHAR) AS kids
        FROM (SELECT *, {key} AS k, (row_number() OVER (PARTITION BY {key} ORDER BY id) - 1) // 1000 AS page FROM {children})
        GROUP BY k, page) c ON c.k = p.id"""
_CONTACT = "struct_pack(id := id, name := name, is_primary := is_primary)"


@query(
    "vendors_nested",
    _NESTED.format(out="contacts", parents="v_vendors", children="v_vendor_contacts", key="vendor_id", fields=_CONTACT),
)
def vendors_nested(v):
    nested = nest_children(
        v.vendors.select("id", "name"), v.vendor_contacts, {"id": "vendor_id"}, "id", ["id", "name", "is_primary"], "contacts"
    )
    return _as_json(nested, "contacts")


@query(
    "schools_nested",
    _NESTED.format(out="contacts", parents="v_schools", children="v_school_contacts", key="school_id", fields=_CONTACT),
)
def schools_nested(v):
    nested = nest_children(
        v.schools.select("id", "name"), v.school_contacts, {"id": "school_id"}, "id", ["id", "name", "is_primary"], "contacts"
    )
    return _as_json(nested, "contacts")


@query(
    "insurers_nested",
    _NESTED.format(
        out="types", parents="v_insurers", children="v_types", key="insurer_id", fields="struct_pack(id := id, name := name)"
    ),
)
def insurers_nested(v):
    nested = nest_children(v.insurers, v.insurance_types, {"id": "insurer_id"}, "id", ["id", "name"], "types")
    return _as_json(nested, "types")


@query(
    "primary_contact",
    """
    SELECT id, parent_id, is_primary AND id = min(CASE WHEN is_primary THEN id END) OVER (PARTITION BY parent_id) AS is_primary
    FROM v_contacts""",
)
def primary_contact(v):
    return masters.single_primary(v.contacts, "parent_id", "id").select("id", "parent_id", "is_primary")


@query(
    "fn_child_clean",
    """
    SELECT c_custkey AS id, nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, '') AS name,
           CASE WHEN c_custkey % 3 = 0 THEN FALSE ELSE c_mktsegment = 'BUILDING' END AS is_primary
    FROM customer WHERE trim(CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END) <> ''""",
)
def fn_child_clean(v):
    base = v.table("customer")
    titled = base.withColumn("name", F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")))
    rows = masters.named_children(titled).select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment") == "BUILDING").alias("is_primary"),
    )
    return masters.clean_contacts(rows)


# Changes ---------------------------------------------------------------------

_ORDER_CHANGES = """
    changed AS (SELECT o_orderkey AS id, o_orderkey % 7 = 0 AS upd, o_orderkey % 11 = 0 AS del FROM orders)"""


def _change_log(v):
    """Updates for every seventh project and one unknown key each, deletes for every eleventh."""
    base = v.projects.select("id", "name", "award_amount")
    updates = base.filter(F.col("id") % 7 == 0)
    first = updates.withColumns({"seq": F.lit(1), "name": F.concat(F.lit("old "), "name"), "op": F.lit("update")})
    second = updates.withColumns({"seq": F.lit(2), "name": F.concat(F.lit("new "), "name"), "op": F.lit("update")})
    unknown = second.withColumn("id", -F.col("id") - 1)
    deletes = base.filter(F.col("id") % 11 == 0).withColumns({"seq": F.lit(3), "op": F.lit("delete")})
    return base, first.unionByName(second).unionByName(unknown).unionByName(deletes)


@query(
    "apply_updates",
    f"""
    WITH {_ORDER_CHANGES}
    SELECT p.id, CASE WHEN upd THEN 'new ' || name ELSE name END AS name, award_amount
    FROM v_projects p JOIN changed c ON c.id = p.id""",
)
def apply_updates(v):
    base, log = _change_log(v)
    return changes.apply_updates(base, log.filter("op = 'update'").drop("op"), "id", "seq")


@query(
    "refused_updates",
    """
    SELECT p_partkey AS id, '學校名稱為必填' AS error FROM part WHERE p_partkey % 6 = 0""",
)
def refused_updates(v):
    name = F.when(F.col("p_partkey") % 6 == 0, F.lit("　 ")).otherwise(F.col("p_name"))
    rows = v.table("part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return changes.refused_updates(rows, "schools").select("id", "error")


@query(
    "replace_types",
    """
    SELECT p_partkey AS id, p_size AS insurer_id, p_type AS name FROM part WHERE p_size % 4 <> 0
    UNION ALL
    SELECT p_partkey, p_size, p_type || '*' FROM part WHERE p_size % 4 = 0 AND p_partkey % 5 <> 0""",
)
def replace_types(v):
    types = v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("insurer_id"), F.col("p_type").alias("name"))
    fresh = types.filter(F.col("insurer_id") % 4 == 0)
    fresh = fresh.withColumn("name", F.when(F.col("id") % 5 == 0, F.lit(" ")).otherwise(F.concat("name", F.lit("*"))))
    return changes.replace_children(types, fresh, fresh, "insurer_id", "id")


@query(
    "refused_deletes",
    """
    SELECT 'vendors' AS table_name, id FROM v_vendors WHERE id % 3 = 0 AND id IN (SELECT vendor_id FROM v_projects)
    UNION ALL SELECT 'schools', id FROM v_schools WHERE id % 3 = 0 AND id IN (SELECT school_id FROM v_projects)""",
)
def refused_deletes(v):
    def refused(table, name, column):
        found = changes.refused_deletes(table.filter(F.col("id") % 3 == 0), [(v.projects, column)])
        return found.select(F.lit(name).alias("table_name"), "id")

    return refused(v.vendors, "vendors", "vendor_id").unionByName(refused(v.schools, "schools", "school_id"))


@query(
    "unknown_updates",
    f"WITH {_ORDER_CHANGES} SELECT -id - 1 AS id FROM changed WHERE upd",
)
def unknown_updates(v):
    base, log = _change_log(v)
    return changes.unknown_updates(base, log.filter("op = 'update'"), "id").select("id")


@query(
    "merge_changes",
    f"""
    WITH {_ORDER_CHANGES}
    SELECT p.id, CASE WHEN upd THEN 'new ' || name ELSE name END AS name, award_amount
    FROM v_projects p JOIN changed c ON c.id = p.id WHERE NOT del""",
)
def merge_changes(v):
    base, log = _change_log(v)
    return changes.merge_changes(base, log, "id", "seq")


@query(
    "stored_changes",
    f"""
    WITH {_ORDER_CHANGES}
    SELECT p.id, CASE WHEN upd THEN 'new ' || name ELSE name END AS name, award_amount
    FROM v_projects p JOIN changed c ON c.id = p.id WHERE NOT del""",
)
def stored_changes(v):
    """The same changes on a stored table: only buckets with changed ids are read and written again."""
    base, log = _change_log(v)
    path, buckets = f"{shared_folder(v.spark)}/stored-changes-{uuid.uuid4().hex}", 32
    stored.write_by_key(base, path, "id", buckets)
    for _ in range(2):  # a rerun changes nothing
        stored.change_by_key(v.spark, path, base.schema, log, "id", buckets, lambda rows, c: changes.merge_changes(rows, c, "id", "seq"))
    return stored.read_by_key(v.spark, path, base.schema).drop(stored.KEY_BUCKET)


@query(
    "cascade_delete",
    """
    SELECT 'projects' AS table_name, id AS id FROM v_projects WHERE id % 11 <> 0
    UNION ALL SELECT 'submission_history', id FROM v_ledger WHERE project_id % 11 <> 0
    UNION ALL SELECT 'vendor_contacts', id FROM v_vendor_contacts WHERE vendor_id % 11 <> 0 OR vendor_id NOT IN (SELECT id FROM v_vendors)
    UNION ALL SELECT 'school_contacts', id FROM v_school_contacts WHERE school_id % 11 <> 0 OR school_id NOT IN (SELECT id FROM v_schools)
    UNION ALL SELECT 'insurance_types', id FROM v_types WHERE insurer_id <> 1""",
)
def cascade_delete(v):
    gone = v.projects.filter(F.col("id") % 11 == 0).select("id")
    parents = changes.delete_rows(v.projects, gone, "id").select(F.lit("projects").alias("table_name"), "id")
    found = parents
    for name, children, parents, key in (
        ("submission_history", v.ledger, gone, "project_id"),
        ("vendor_contacts", v.vendor_contacts, v.vendors.filter(F.col("id") % 11 == 0), "vendor_id"),
        ("school_contacts", v.school_contacts, v.schools.filter(F.col("id") % 11 == 0), "school_id"),
        ("insurance_types", v.insurance_types, v.insurers.filter(F.col("id") == 1), "insurer_id"),
    ):
        found = found.unionByName(changes.delete_rows(children, parents, key).select(F.lit(name).alias("table_name"), "id"))
    return found


@query(
    "replace_children",
    """
    SELECT id, school_id, name, is_primary FROM v_school_contacts WHERE school_id % 3 <> 0
    UNION ALL
    SELECT id, school_id, name || '*', coalesce(id = min(id) OVER (PARTITION BY school_id), FALSE)
    FROM v_school_contacts WHERE school_id % 3 = 0""",
)
def replace_children(v):
    replaced = v.schools.filter(F.col("id") % 3 == 0).select(F.col("id").alias("school_id"))
    fresh = v.school_contacts.filter(F.col("school_id") % 3 == 0).withColumns(
        {"name": F.concat("name", F.lit("*")), "is_primary": F.lit(True)}
    )
    return changes.replace_children(v.school_contacts, replaced, fresh, "school_id", "id")


@query(
    "master_intake",
    """
    SELECT t.table_name, p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_name END AS name, p_partkey % 6 <> 0 AS accepted,
           CASE WHEN p_partkey % 6 = 0 THEN t.error END AS error
    FROM part, (VALUES ('vendors', '廠商名稱為必填'), ('schools', '學校名稱為必填'), ('insurers', '保險公司名稱為必填'),
                       ('projects', '工程名稱為必填')) AS t(table_name, error)""",
)
def master_intake(v):
    name = F.when(F.col("p_partkey") % 6 == 0, F.lit(" \t　")).otherwise(F.concat(F.lit("　"), "p_name", F.lit(" ")))
    rows = v.table("part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    found = [changes.intake_named(rows, name).withColumn("table_name", F.lit(name)) for name in changes.NAME_REQUIRED]
    return functools.reduce(DataFrame.unionByName, found)


@query(
    "settings_latest",
    """
    SELECT key, arg_max(value, seq) AS value FROM v_changes
    WHERE key <> 'settlement_day' OR TRY_CAST(value AS BIGINT) BETWEEN 1 AND 28 GROUP BY key""",
)
def settings_latest(v):
    return lists.latest_settings(v.setting_changes)


@query(
    "settlement_day",
    """
    SELECT coalesce((SELECT arg_max(CAST(value AS BIGINT), seq) FROM v_changes
                     WHERE key = 'settlement_day' AND TRY_CAST(value AS BIGINT) BETWEEN 1 AND 28), 5) AS settlement_day""",
)
def settlement_day(v):
    return lists.settlement_day(lists.latest_settings(v.setting_changes))


@query(
    "report_backfill",
    """
    SELECT id, project_id, CASE WHEN g.gid IS NOT NULL THEN 'output/new_' || id ELSE report_path END AS report_path
    FROM v_ledger LEFT JOIN (SELECT DISTINCT id AS gid FROM v_ledger WHERE id % 3 = 0) g ON g.gid = id""",
)
def report_backfill(v):
    made = v.ledger.filter(F.col("id") % 3 == 0).select("id").distinct()
    made = made.withColumn("report_path", F.concat(F.lit("output/new_"), F.col("id").cast("string")))
    return changes.backfill_reports(v.ledger, made).select("id", "project_id", "report_path")


@query(
    "submission_delete_plan",
    """
    SELECT id, 'daily_log_path' AS kind, daily_log_path AS path FROM v_ledger
    WHERE project_id % 5 = 0 AND daily_log_path LIKE 'uploads/%'
    UNION ALL
    SELECT id, 'report_path', report_path FROM v_ledger WHERE project_id % 5 = 0 AND report_path IS NOT NULL""",
)
def submission_delete_plan(v):
    gone = v.ledger.filter(F.col("project_id") % 5 == 0).select("id")
    return changes.deletion_plan(v.ledger, gone)


# Checks ----------------------------------------------------------------------


@query(
    "fk_violations",
    """
    SELECT 'projects' AS table_name, 'school_id' AS column_name, school_id AS value, count(*) AS n FROM v_projects
    WHERE school_id NOT IN (SELECT id FROM v_schools WHERE id % 9 <> 0) GROUP BY school_id
    UNION ALL
    SELECT 'projects', 'vendor_id', vendor_id, count(*) FROM v_projects
    WHERE vendor_id NOT IN (SELECT id FROM v_vendors) GROUP BY vendor_id
    UNION ALL
    SELECT 'vendor_contacts', 'vendor_id', vendor_id, count(*) FROM v_vendor_contacts
    WHERE vendor_id NOT IN (SELECT id FROM v_vendors) GROUP BY vendor_id
    UNION ALL
    SELECT 'school_contacts', 'school_id', school_id, count(*) FROM v_school_contacts
    WHERE school_id NOT IN (SELECT id FROM v_schools WHERE id % 9 <> 0) GROUP BY school_id
    UNION ALL
    SELECT 'submission_history', 'project_id', project_id, count(*) FROM v_ledger
    WHERE project_id NOT IN (SELECT id FROM v_projects) GROUP BY project_id""",
)
def fk_violations(v):
    return quality.fk_violations(
        {
            "vendors": v.vendors,
            "schools": v.schools.filter(F.col("id") % 9 != 0),
            "insurers": v.insurers,
            "insurance_types": v.insurance_types,
            "vendor_contacts": v.vendor_contacts,
            "school_contacts": v.school_contacts,
            "projects": v.projects,
            "submission_history": v.ledger,
        }
    )


@query(
    "key_violations",
    """
    SELECT 'vendors' AS table_name, 'name' AS column_name, 'blank' AS rule, name AS value, count(*) AS n
    FROM (SELECT CASE WHEN id % 8 = 0 THEN ' ' ELSE name END AS name FROM v_vendors) WHERE trim(name) = '' GROUP BY name
    UNION ALL
    SELECT 'users', 'username', 'repeated', username, count(*)
    FROM (SELECT CASE WHEN id % 6 = 0 THEN role ELSE username END AS username FROM v_users) GROUP BY username HAVING count(*) > 1
    UNION ALL
    SELECT 'settings', 'key', 'repeated', key, count(*) FROM v_changes GROUP BY key HAVING count(*) > 1""",
)
def key_violations(v):
    return quality.key_violations(
        {
            "vendors": v.vendors.withColumn("name", F.when(F.col("id") % 8 == 0, " ").otherwise(F.col("name"))),
            "users": v.users.withColumn("username", F.when(F.col("id") % 6 == 0, F.col("role")).otherwise(F.col("username"))),
            "settings": v.setting_changes,
        }
    )


@query(
    "type_mismatch",
    """
    SELECT p.id AS project_id, p.insurer_id, p.insurance_type_id, t.insurer_id AS type_insurer_id
    FROM v_projects p JOIN v_types t ON t.id = p.insurance_type_id WHERE p.insurer_id IS DISTINCT FROM t.insurer_id""",
)
def type_mismatch(v):
    return quality.type_mismatch(v.projects, v.insurance_types)


@query(
    "latest_project_rows",
    """
    SELECT project_id, max(period) AS period, arg_max(id, (period, id)) AS id FROM v_ledger GROUP BY project_id""",
)
def latest_project_rows(v):
    return latest(v.ledger.select("project_id", "period", "id"), ["project_id"], ["period", "id"])
