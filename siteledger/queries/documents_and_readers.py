"""Import lists and the reader catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masters, readers
from ..operators.pages import page_lines, regroup_lines
from ..sources import lists
from .registry import query

# Import lists ----------------------------------------------------------------


def _lines(v):
    return lists.import_lines(v.documents, "doc_id", "text")


def _known(v):
    return lists.import_lines(v.benchmark, "item_id", "text").select("name")


@query("import_lines", "SELECT doc_id, line_no, name FROM v_lines")
def import_lines(v):
    return _lines(v)


@query(
    "vendor_import",
    """
    SELECT name, min(doc_id) AS doc_id, arg_min(line_no, (doc_id, line_no)) AS line_no FROM v_lines
    WHERE name NOT IN (SELECT name FROM v_known) GROUP BY name""",
)
def vendor_import(v):
    return masters.import_names(_lines(v), ["doc_id", "line_no"], _known(v))


@query(
    "vendor_import_totals",
    """
    SELECT count(DISTINCT name) FILTER (name NOT IN (SELECT name FROM v_known)) AS created,
           count(*) - count(DISTINCT name) FILTER (name NOT IN (SELECT name FROM v_known)) AS skipped
    FROM v_lines""",
)
def vendor_import_totals(v):
    return masters.import_totals(_lines(v), _known(v))


# Page lines ------------------------------------------------------------------


@query(
    "page_lines",
    """
    SELECT doc_id AS file_id, 1 AS page, line_no, line AS text
    FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no
          FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
)
def page_lines_query(v):
    """Every word of the documents as a positioned item; the lines come back whole."""
    lines = v.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("t", "(?<= )")).alias("w", "str"))
    items = words.select(
        F.col("doc_id").alias("file_id"),
        F.lit(1).alias("page"),
        (F.col("line").cast("bigint") * 2**24 + F.col("w")).alias("item_no"),
        (-F.col("line")).cast("double").alias("y"),
        "str",
    )
    # item numbers leave 2**24 places to a line: 512 lines to a bucket
    return page_lines(items, bucket=F.floor(F.col("item_no") / 2**33))


@query(
    "turn_groups",
    """
    SELECT conv_id, turn, role, CAST(grp - 1 AS BIGINT) AS group_no
    FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM conversations)
    WHERE grp > 0""",
)
def turn_groups(v):
    """Conversation turns regrouped: a user turn opens a record, other turns continue it."""
    turns = v.table("conversations").select("conv_id", "turn", "role")
    grouped = regroup_lines(turns, ["conv_id"], "turn", F.col("role") == "user", "group_no")
    return grouped.select("conv_id", "turn", "role", "group_no")


# Readers ---------------------------------------------------------------------


@query(
    "reader_catalog",
    """
    SELECT vendor_key, file_name, version FROM (
        SELECT *, row_number() OVER (PARTITION BY vendor_key ORDER BY file_name DESC) AS rn
        FROM v_uploads WHERE load_ok AND vendor_key <> '' AND file_name LIKE '%.pmisparser.js') WHERE rn = 1""",
)
def reader_catalog(v):
    return lists.reader_catalog(v.uploads).select("vendor_key", "file_name", "version")


@query(
    "reader_validation",
    """
    SELECT file_name, CASE
        WHEN expected_key = 'a/b' THEN '廠商鍵不合法(須為非空廠商名稱,不含檔名危險字元)'
        WHEN NOT is_empty AND load_ok AND has_meta AND vendor_key NOT IN ('', ' bad', 'a/b') AND vendor_key <> expected_key
        THEN '讀取檔廠商鍵(' || vendor_key || ')與此廠商(' || expected_key || ')不符,避免裝錯家'
        ELSE rule_error END AS error,
        rule_error IS NULL AND vendor_key = expected_key AND expected_key <> 'a/b' AS ok
    FROM v_checked""",
)
def reader_validation(v):
    return readers.validate_readers(v.uploads, "expected_key").select("file_name", "error", "ok")


@query(
    "reader_latest",
    """
    SELECT expected_key AS vendor_key, load_seq, version FROM (
        SELECT *, row_number() OVER (PARTITION BY expected_key ORDER BY load_seq DESC) AS rn FROM v_checked
        WHERE expected_key <> 'a/b' AND (op = 'remove' OR op = 'install' AND rule_error IS NULL AND vendor_key = expected_key))
    WHERE rn = 1 AND op = 'install'""",
)
def reader_latest(v):
    return readers.apply_reader_log(v.uploads).select("vendor_key", "load_seq", "version")


@query(
    "reader_overview",
    """
    SELECT v.id AS vendor_id, v.name AS vendor_name, r.vendor_key IS NOT NULL AS installed, r.version,
           coalesce(r.target_fields, '-') AS target_fields, r.installed_at
    FROM v_vendors v LEFT JOIN v_readers r ON r.vendor_key = v.name""",
)
def reader_overview(v):
    return readers.reader_overview(v.vendors, v.readers)


@query(
    "reader_overview_all",
    """
    SELECT 'vendor' AS kind, v.id AS vendor_id, v.name AS vendor_name, CAST(NULL AS VARCHAR) AS vendor_key,
           r.vendor_key IS NOT NULL AS installed, r.version, coalesce(r.target_fields, '-') AS target_fields, r.installed_at
    FROM v_vendors v LEFT JOIN v_readers r ON r.vendor_key = v.name
    UNION ALL
    SELECT 'orphan', NULL, NULL, vendor_key, NULL, version, target_fields, NULL FROM v_readers
    WHERE vendor_key NOT IN (SELECT name FROM v_vendors)""",
)
def reader_overview_all(v):
    return readers.reader_overview_all(v.vendors, v.readers)


@query(
    "reader_orphans",
    "SELECT vendor_key, version FROM v_readers WHERE vendor_key NOT IN (SELECT name FROM v_vendors)",
)
def reader_orphans(v):
    return readers.reader_orphans(v.vendors, v.readers).select("vendor_key", "version")


@query(
    "project_reader",
    """
    SELECT p.id, v.name AS vendor_name, r.version AS reader_version
    FROM v_projects p LEFT JOIN v_vendors v ON v.id = p.vendor_id LEFT JOIN v_readers r ON r.vendor_key = v.name""",
)
def project_reader(v):
    named = masters.project_vendors(v.projects, v.vendors)
    return readers.project_readers(named, v.readers).select("id", "vendor_name", "reader_version")


@query(
    "bulk_match",
    """
    SELECT file_name, vendor_key, m.id AS matched_vendor_id, CASE WHEN m.id IS NULL THEN 'unmatched:查無同名廠商' END AS match_error
    FROM v_uploads LEFT JOIN (SELECT name, min(id) AS id FROM v_vendors GROUP BY name) m ON m.name = vendor_key""",
)
def bulk_match(v):
    return readers.bulk_match(v.uploads, v.vendors).select("file_name", "vendor_key", "matched_vendor_id", "match_error")


@query("bulk_install", "SELECT file_name, vendor_key, matched_vendor_id, ok, error FROM v_bulk")
def bulk_install(v):
    return readers.bulk_install(v.uploads, v.vendors)


@query(
    "bulk_result_class",
    """
    SELECT file_name, CASE WHEN ok THEN 'submitted' WHEN starts_with(error, 'unmatched') THEN 'pending' ELSE 'overdue' END
           AS result_class
    FROM v_bulk""",
)
def bulk_result_class(v):
    return readers.bulk_result_class(readers.bulk_install(v.uploads, v.vendors)).select("file_name", "result_class")


@query("bulk_totals", "SELECT count(*) FILTER (ok) AS ok_count, count(*) AS total FROM v_bulk")
def bulk_totals(v):
    return readers.bulk_totals(readers.bulk_install(v.uploads, v.vendors))


@query(
    "bundled_readers",
    """
    SELECT file_name, vendor_key, version, target_fields,
           vendor_key IN (SELECT name FROM v_vendors) AS vendor_exists,
           vendor_key IN (SELECT vendor_key FROM v_readers) AS installed
    FROM v_checked WHERE rule_error IS NULL AND file_name LIKE '%.pmisparser.js'""",
)
def bundled_readers(v):
    found = readers.bundled_readers(v.uploads, v.vendors, v.readers)
    return found.withColumn("target_fields", F.array_join("target_fields", "、"))


@query(
    "vendors_to_create",
    """
    SELECT DISTINCT vendor_key AS name FROM v_checked
    WHERE rule_error IS NULL AND file_name LIKE '%.pmisparser.js' AND vendor_key NOT IN (SELECT name FROM v_vendors)""",
)
def vendors_to_create(v):
    return readers.vendors_to_create(v.uploads, v.vendors)
