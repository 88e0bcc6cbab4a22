"""Submissions, report outcomes, report content and log checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dates import month_of
from ..operators import quality
from ..plans import report, submission
from ..session import shared_folder
from ..sources.star_views import PAGE_STEP
from .registry import query

# Sheets of one day are numbered PAGE_STEP apart; a bucket spans 64 days.
BUCKET = 64 * PAGE_STEP


@query(
    "submission_intake",
    """
    SELECT l_orderkey AS project_id, l_linenumber,
           CASE l_returnflag WHEN 'R' THEN 'supervision' ELSE 'monthly' END AS type,
           CASE WHEN l_partkey % 9 = 0 THEN '2026-13' WHEN l_partkey % 9 = 1 THEN strftime(l_shipdate, '%Y/%m')
                ELSE strftime(l_shipdate, '%Y-%m') END AS period,
           l_partkey % 9 > 1 AS accepted,
           CASE WHEN l_partkey % 9 <= 1 THEN '週期格式須為 YYYY-MM' END AS error
    FROM lineitem""",
)
def submission_intake(v):
    return report.intake(_requests(v)).select("project_id", "l_linenumber", "type", "period", "accepted", "error")


def _requests(v):
    form = F.when(F.col("l_partkey") % 9 == 0, F.lit("2026-13")).when(
        F.col("l_partkey") % 9 == 1, F.date_format("l_shipdate", "yyyy/MM")
    ).otherwise(month_of("l_shipdate"))
    kind = F.when(F.col("l_returnflag") == "R", "supervision").when(F.col("l_returnflag") == "A", "other")
    return v.table("lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        "l_linenumber",
        "l_partkey",
        F.concat(F.lit(" "), form, F.lit("　")).alias("period"),
        kind.alias("type"),
    )


@query(
    "submission_append",
    """
    SELECT l_orderkey AS project_id, l_linenumber, strftime(l_shipdate, '%Y-%m') AS period,
           CASE l_returnflag WHEN 'R' THEN 'supervision' ELSE 'monthly' END AS type,
           strftime(l_shipdate, '%Y-%m') || '-05' AS deadline
    FROM lineitem WHERE l_partkey % 9 > 1""",
)
def submission_append(v):
    rows = report.ledger_rows(_requests(v), F.lit(5))
    return rows.select("project_id", "l_linenumber", "period", "type", "deadline")


@query(
    "artifact_paths",
    """
    SELECT l_orderkey AS project_id, l_linenumber,
           'output/proj_' || l_orderkey || '/監造報表_' || strftime(l_shipdate, '%Y-%m') || '_monthly_' || l_partkey || '.xlsx' AS report_path,
           'uploads/proj_' || l_orderkey || '/' || l_partkey || '_日誌_' || l_linenumber || '_.pdf' AS upload_path
    FROM lineitem""",
)
def artifact_paths(v):
    name = F.concat(F.lit("日誌:"), F.col("l_linenumber").cast("string"), F.lit("?.pdf"))
    sent = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    key, stamp = F.col("l_orderkey"), F.col("l_partkey")
    return v.table("lineitem").select(
        key.alias("project_id"),
        "l_linenumber",
        report.report_path(key, month_of("l_shipdate"), F.lit("monthly"), stamp).alias("report_path"),
        report.upload_path(key, stamp, sent).alias("upload_path"),
    )


@query(
    "artifact_availability",
    """
    SELECT id, 'daily_log' AS kind, CASE WHEN daily_log_path IS NULL THEN 404 WHEN daily_log_path LIKE '..%' THEN 400 ELSE 200 END AS status
    FROM v_ledger
    UNION ALL SELECT id, 'report', CASE WHEN report_path IS NULL THEN 409 ELSE 200 END FROM v_ledger
    UNION ALL SELECT id, 'official_doc', 409 FROM v_ledger""",
)
def artifact_availability(v):
    return report.artifact_availability(v.ledger)


@query(
    "available_months",
    """
    SELECT file_id, string_agg(m, '、' ORDER BY m) AS months_text
    FROM (SELECT DISTINCT file_id, substr(log_date_raw, 1, 7) AS m FROM v_days WHERE log_date_raw IS NOT NULL) GROUP BY file_id""",
)
def available_months(v):
    return report.available_months(v.days).select("file_id", "months_text")


@query(
    "report_outcome",
    """
    WITH months AS (SELECT file_id, string_agg(m, '、' ORDER BY m) AS months_text
                    FROM (SELECT DISTINCT file_id, substr(log_date_raw, 1, 7) AS m FROM v_days WHERE log_date_raw IS NOT NULL) GROUP BY file_id),
    counted AS (SELECT submission_id, sum(n) AS n_days
                FROM (SELECT submission_id, 1 AS n FROM v_kept UNION ALL SELECT submission_id, 0 FROM v_subs) GROUP BY submission_id),
    judged AS (SELECT s.*, n_days, CASE
        WHEN vendor_name IS NULL THEN '此工程尚未指定廠商,無法自動產生監造報表'
        WHEN reader_key IS NULL THEN '此廠商尚未安裝讀取器,無法自動產生監造報表'
        WHEN parse_error IS NOT NULL THEN '施工日誌解析失敗:' || parse_error
        WHEN n_days = 0 AND type = 'monthly' AND months_text IS NOT NULL
        THEN '此施工日誌沒有 ' || period || ' 的資料;檔案內含月份:' || months_text || '。請改選其中一個月份再產生。'
        WHEN n_days = 0 THEN '施工日誌解析失敗:未取得可對應的日誌天數(檔案可能格式不符或無逐日資料)' END AS reason
        FROM v_subs s JOIN counted c ON c.submission_id = s.submission_id LEFT JOIN months m ON m.file_id = s.file_id)
    SELECT submission_id, project_id, period, type, reason IS NULL AS report_generated, reason,
           CAST(CASE WHEN reason IS NULL THEN n_days ELSE 0 END AS BIGINT) AS n_days FROM judged""",
)
def report_outcome(v):
    return report.report_outcome(v.report_submissions, v.days)


_REQUESTS = """
    requests AS (SELECT submission_id, CASE WHEN project_id % 29 = 0 THEN -project_id ELSE project_id END AS project_id, type, file_id, parse_error,
                        period, project_id % 31 = 0 AS bad_period, project_id % 37 <> 0 AS has_file, project_id AS stamp FROM v_subs)"""


def _submission_requests(v):
    """Each submission as it is sent in; some for no project, some with a bad period, some without a file."""
    p = F.col("project_id")
    return v.found_submissions.select(
        "submission_id",
        F.when(p % 29 == 0, -p).otherwise(p).alias("project_id"),
        F.when(p % 31 == 0, F.replace("period", F.lit("-"), F.lit("/"))).otherwise(F.concat(F.lit(" "), "period")).alias("period"),
        "type",
        F.when(p % 37 != 0, F.concat(F.lit("uploads/"), "submission_id", F.lit(".pdf"))).alias("daily_log_path"),
        "file_id", "parse_error", p.alias("stamp"),
    )


@query(
    "submission_job",
    f"""
    WITH {_REQUESTS},
    judged AS (SELECT r.*, p.id IS NULL AS unknown, vendor_id FROM requests r LEFT JOIN v_projects p ON p.id = r.project_id),
    taken AS (SELECT j.*, v.name AS vendor_name, k.vendor_key AS reader_key FROM judged j LEFT JOIN v_vendors v ON v.id = j.vendor_id
              LEFT JOIN v_readers k ON k.vendor_key = v.name WHERE NOT unknown AND NOT bad_period AND has_file),
    months AS (SELECT file_id, string_agg(m, '、' ORDER BY m) AS months_text
               FROM (SELECT DISTINCT file_id, substr(log_date_raw, 1, 7) AS m FROM v_days WHERE log_date_raw IS NOT NULL) GROUP BY file_id),
    counted AS (SELECT submission_id, sum(n) AS n_days
                FROM (SELECT submission_id, 1 AS n FROM v_kept UNION ALL SELECT submission_id, 0 FROM v_subs) GROUP BY submission_id),
    o AS (SELECT t.*, n_days, CASE
        WHEN vendor_name IS NULL THEN '此工程尚未指定廠商,無法自動產生監造報表'
        WHEN reader_key IS NULL THEN '此廠商尚未安裝讀取器,無法自動產生監造報表'
        WHEN parse_error IS NOT NULL THEN '施工日誌解析失敗:' || parse_error
        WHEN n_days = 0 AND type = 'monthly' AND months_text IS NOT NULL
        THEN '此施工日誌沒有 ' || period || ' 的資料;檔案內含月份:' || months_text || '。請改選其中一個月份再產生。'
        WHEN n_days = 0 THEN '施工日誌解析失敗:未取得可對應的日誌天數(檔案可能格式不符或無逐日資料)' END AS reason
        FROM taken t JOIN counted c ON c.submission_id = t.submission_id LEFT JOIN months m ON m.file_id = t.file_id),
    l AS (SELECT submission_id, count(*) AS n_lines FROM v_report_lines GROUP BY submission_id)
    SELECT j.submission_id, j.project_id, CASE WHEN j.bad_period THEN replace(j.period, '-', '/') ELSE j.period END AS period, j.type,
           CASE WHEN j.unknown THEN 404 WHEN j.bad_period OR NOT j.has_file THEN 400 ELSE 201 END AS status,
           CASE WHEN j.unknown THEN '工程不存在' WHEN j.bad_period THEN '週期格式須為 YYYY-MM' WHEN NOT j.has_file THEN '請上傳施工日誌檔' END AS error,
           CASE WHEN o.submission_id IS NOT NULL THEN j.period || '-05' END AS deadline,
           CASE WHEN o.submission_id IS NOT NULL THEN reason IS NULL END AS report_generated, reason,
           CAST(CASE WHEN reason IS NULL THEN n_days WHEN o.submission_id IS NOT NULL THEN 0 END AS BIGINT) AS n_days,
           CASE WHEN o.submission_id IS NOT NULL AND reason IS NULL
                THEN 'output/proj_' || j.project_id || '/監造報表_' || j.period || '_' || j.type || '_' || j.stamp || '.xlsx' END AS report_path,
           CASE WHEN o.submission_id IS NOT NULL AND reason IS NULL THEN n_lines END AS n_lines
    FROM judged j LEFT JOIN o ON o.submission_id = j.submission_id LEFT JOIN l ON l.submission_id = j.submission_id""",
)
def submission_job(v):
    """Every request with its answer, and the lines that its stored report has after a rerun."""
    days = v.dated_days.select("file_id", "day_pos", "log_date_raw")
    run = submission.submit(
        _submission_requests(v), v.projects, v.vendors, v.readers, v.default_settings, days,
        lambda files: v.of_files(files).items.drop("log_date_raw"), BUCKET, v.by_file,
    )
    folder = f"{shared_folder(v.spark)}/submission-job-{uuid.uuid4().hex}"
    for _ in range(2):  # as after a retry: what is stored stays the same
        submission.store_run(run, f"{folder}/ledger", f"{folder}/lines")
    stored = v.spark.read.schema(run.ledger.schema).parquet(f"{folder}/ledger").select(F.col("id").alias("submission_id"), F.col("report_path").alias("stored_path"))
    lines = v.spark.read.schema(run.lines.schema).parquet(f"{folder}/lines").groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_lines"))
    answers = run.results.join(stored, "submission_id", "left").join(lines, "submission_id", "left")
    return answers.withColumn("report_path", F.col("stored_path")).drop("stored_path")


@query("report_days", "SELECT submission_id, day_pos, log_date_raw FROM v_kept")
def report_days(v):
    return report.report_days(v.report_submissions, v.days, v.by_file).select("submission_id", "day_pos", "log_date_raw")


@query("sheet_names", "SELECT submission_id, day_pos, sheet_name FROM v_sheets")
def sheet_names(v):
    named = report.with_sheet_names(v.days.select("file_id", "day_pos", "log_date_raw"), BUCKET, v.by_file)
    return report.report_days(v.report_submissions, named, v.by_file).select("submission_id", "day_pos", "sheet_name")


@query(
    "report_sheets",
    """
    SELECT submission_id, sheet_name, log_date_raw FROM v_sheets
    UNION ALL
    SELECT submission_id, '監造報表', NULL FROM v_subs WHERE submission_id NOT IN (SELECT submission_id FROM v_sheets)""",
)
def report_sheets(v):
    sheets = report.report_sheets(v.report_submissions, v.days, BUCKET, v.by_file)
    return sheets.select("submission_id", "sheet_name", "log_date_raw")


@query(
    "report_project_header",
    """
    SELECT id AS project_id, name AS project_name, project_no,
           CASE WHEN award_amount IS NULL THEN '' WHEN award_amount = floor(award_amount)
                THEN CAST(CAST(award_amount AS BIGINT) AS VARCHAR) ELSE CAST(award_amount AS VARCHAR) END AS award,
           strftime(start_date, '%Y-%m-%d') AS start_date,
           strftime(contract_completion_date, '%Y-%m-%d') AS contract_completion_date
    FROM v_projects""",
)
def report_project_header(v):
    heads = report.report_project_header(v.projects)
    return heads.select(
        "project_id", "project_name", "project_no", F.col("award_amount").alias("award"), "start_date", "contract_completion_date"
    )


@query(
    "report_header_block",
    """
    WITH base AS (SELECT s.submission_id, coalesce(x.sheet_name, '監造報表') AS sheet_name, x.*  EXCLUDE (submission_id, sheet_name, project_id),
                         p.name AS head_name, p.project_no, p.start_date, p.contract_completion_date,
                         CASE WHEN award_amount IS NULL THEN '' WHEN award_amount = floor(award_amount)
                              THEN CAST(CAST(award_amount AS BIGINT) AS VARCHAR) ELSE CAST(award_amount AS VARCHAR) END AS award
                  FROM v_reportable s LEFT JOIN v_sheets x ON x.submission_id = s.submission_id
                  LEFT JOIN v_projects p ON p.id = s.project_id)
    SELECT submission_id, sheet_name, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]) AS pos,
           unnest(['本日天氣　上午', '下午', '填報日期', '工程名稱', '工程編號', '契約工期(天)', '開工日期', '契約竣工日',
                   '契約金額', '決標金額', '實際完工日期', '預定進度(%)', '實際進度(%)', '契約變更次數']) AS label,
           unnest([coalesce(weather_am, ''), '',
                   trim(coalesce(log_date_raw, '') || ' ' || coalesce('(' || weekday || ')', '')),
                   head_name, project_no, '', strftime(start_date, '%Y-%m-%d'), strftime(contract_completion_date, '%Y-%m-%d'),
                   award, award, '', '', CASE WHEN actual_pct IS NULL THEN '' WHEN actual_pct = floor(actual_pct)
                                THEN CAST(CAST(actual_pct AS BIGINT) AS VARCHAR) ELSE CAST(actual_pct AS VARCHAR) END, '']) AS value
    FROM base""",
)
def report_header_block(v):
    submissions = report.with_heads(report.reportable(v.report_submissions), report.report_project_header(v.projects))
    return report.header_rows(report.report_sheets(submissions, v.days, BUCKET, v.by_file, report.HEAD_FIELDS))


def _lines(v):
    sheets = report.report_sheets(report.reportable(v.report_submissions), v.days.drop("worker_total"), BUCKET, v.by_file)
    return report.report_lines(sheets, v.items.drop("log_date_raw"))


@query(
    "report_lines",
    """
    SELECT submission_id, sheet_name, item_pos, item_no, item_name, unit, unit_price, contract_qty, today_qty, today_amount, cum_qty
    FROM v_report_lines""",
)
def report_lines(v):
    return _lines(v).drop("project_id", "period", "type", "day_pos")


@query(
    "report_lines_display",
    """
    SELECT submission_id, sheet_name, item_pos, item_no, item_name,
           unit, format('{:,.2f}', unit_price) AS unit_price, format('{:,.2f}', contract_qty) AS contract_qty,
           format('{:,.2f}', today_qty) AS today_qty, format('{:,.2f}', today_amount) AS today_amount, format('{:,.2f}', cum_qty) AS cum_qty
    FROM v_report_lines""",
)
def report_lines_display(v):
    return report.lines_display(_lines(v)).drop("project_id", "period", "type", "day_pos")


@query(
    "log_consistency",
    """
    SELECT file_id, day_pos, item_pos, today_amount,
           floor(unit_price * today_qty * 100 + 0.5 + 2.220446049250313e-16) / 100 AS expected_amount
    FROM v_items
    WHERE abs(today_amount - floor(unit_price * today_qty * 100 + 0.5 + 2.220446049250313e-16) / 100) >= 0.005""",
)
def log_consistency(v):
    wrong = quality.amount_mismatch(v.items)
    return wrong.select("file_id", "day_pos", "item_pos", "today_amount", "expected_amount")


@query(
    "cumulative_consistency",
    """
    SELECT * FROM (
        SELECT file_id, item_no, day_no AS day_pos, cum_qty, cum_amount,
               lag(cum_qty) OVER w AS previous_cum_qty, lag(cum_amount) OVER w AS previous_cum_amount
        FROM (SELECT file_id, item_no, day_no, sum(cum_qty) AS cum_qty, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS cum_amount
              FROM (SELECT i.file_id, item_no, i.day_no, i.l_linenumber + l_quantity AS cum_qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
                    FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS item_no FROM v_work) i) GROUP BY ALL)
        WINDOW w AS (PARTITION BY file_id, item_no ORDER BY day_no))
    WHERE cum_qty < previous_cum_qty OR cum_amount < previous_cum_amount""",
)
def cumulative_consistency(v):
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    per_day = v.work.groupBy(
        "file_id", F.col("l_linenumber").cast("string").alias("item_no"), F.col("day_no").alias("day_pos")
    ).agg(F.sum(F.col("l_quantity") + F.col("l_linenumber")).alias("cum_qty"), (cents / 100).alias("cum_amount"))
    return quality.falling_totals(per_day, ["file_id", "item_no"], ["cum_qty", "cum_amount"]).drop("falling")


@query(
    "file_consistency",
    """
    SELECT d.file_id, n_names, n_days, min_items, max_items, n_names = 1 AND min_items = max_items AS consistent
    FROM (SELECT file_id, count(DISTINCT project_name) AS n_names, count(*) AS n_days FROM v_days GROUP BY file_id) d
    JOIN (SELECT file_id, min(n_items) AS min_items, max(n_items) AS max_items FROM v_day_totals GROUP BY file_id) i
      ON i.file_id = d.file_id""",
)
def file_consistency(v):
    return quality.file_consistency(v.days, v.items)
