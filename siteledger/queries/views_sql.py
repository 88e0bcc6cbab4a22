"""The star-schema mapping as SQL, for checking the DataFrame jobs."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_vendors": """
        SELECT s_suppkey AS id, s_name AS name,
               strftime(DATE '1995-01-01' + CAST(s_suppkey % 3000 AS INTEGER), '%Y-%m-%d') AS created_at
        FROM supplier""",
    "v_schools": """
        SELECT c_custkey AS id, c_name AS name, n_name AS county
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "v_insurers": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "v_types": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS insurer_id, n_name AS name
        FROM nation""",
    "v_contacts": """
        SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS parent_id, c_name AS name,
               c_mktsegment = 'BUILDING' AS is_primary
        FROM customer""",
    "v_vendor_contacts": """
        SELECT c_custkey AS id, c_custkey % 97 AS vendor_id, c_name AS name,
               c_mktsegment = 'BUILDING' AS is_primary
        FROM customer""",
    "v_school_contacts": """
        SELECT o_orderkey AS id, o_custkey AS school_id, 'Contact ' || o_orderkey AS name,
               o_orderpriority = '1-URGENT' AS is_primary
        FROM orders""",
    "v_projects": """
        SELECT o_orderkey AS id, 'P-' || o_orderkey AS project_no, 'Project ' || o_orderkey AS name,
               CASE WHEN o_orderkey % 10 <> 0 THEN vendor END AS vendor_id,
               o_custkey AS school_id,
               CAST(o_orderdate AS DATE) AS start_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 365 AS INTEGER) AS contract_completion_date,
               CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * CASE WHEN o_orderkey % 4 = 0 THEN 128 ELSE 1 END END AS award_amount,
               o_orderkey % 5 AS insurer_id,
               (o_orderkey * 7) % 25 AS insurance_type_id,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'lump_sum' ELSE 'pct' END AS design_fee_type,
               CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 1000 + 50000 AS DOUBLE) END AS design_fee_amount,
               CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 10 + 1 AS DOUBLE) END AS design_fee_pct,
               CAST(o_orderdate AS DATE) AS created_at
        FROM orders
        LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS vendor FROM lineitem GROUP BY l_orderkey)
          ON l_orderkey = o_orderkey""",
    "v_fees": """
        SELECT *,
               CASE WHEN design_fee_type = 'lump_sum' THEN design_fee_amount
                    ELSE floor(award_amount * design_fee_pct / 100 + 0.5 + 2.220446049250313e-16) END AS design_fee_actual,
               design_fee_type = 'pct' AND award_amount IS NULL AS design_fee_unbid
        FROM v_projects""",
    "v_users": """
        SELECT c_custkey AS id, c_name AS username,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role
        FROM customer""",
    "v_ledger": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS project_id,
               strftime(l_shipdate, '%Y-%m') AS period,
               CASE WHEN l_returnflag = 'R' THEN 'supervision' ELSE 'monthly' END AS type,
               CASE WHEN l_partkey % 7 = 0 THEN '../secret.txt'
                    WHEN l_partkey % 11 <> 0
                    THEN 'uploads/proj_' || l_orderkey || '/' || l_linenumber || '.pdf' END AS daily_log_path,
               CAST(NULL AS VARCHAR) AS official_doc_path,
               CASE WHEN l_linestatus = 'F' THEN 'output/proj_' || l_orderkey || '/r.xlsx' END AS report_path
        FROM lineitem""",
    "v_changes": """
        SELECT event_id AS seq,
               CASE WHEN event_type = 'click' THEN 'settlement_day' ELSE event_type END AS key,
               CASE WHEN event_type = 'click' THEN '' ELSE 'v' END || CAST(floor(value) AS BIGINT) AS value
        FROM events""",
    "v_readers": """
        SELECT vendor_key || '.pmisparser.js' AS file_name, load_seq, vendor_key, version, '項次、單位' AS target_fields,
               layout, strftime(DATE '2026-01-01' + CAST(load_seq % 300 AS INTEGER), '%Y-%m-%d') AS installed_at
        FROM (SELECT s_suppkey AS load_seq, s_name AS vendor_key, '1.0.' || (s_suppkey % 5) AS version,
                     CASE s_suppkey % 6 WHEN 0 THEN 'text_log' WHEN 2 THEN 'form_sheet' ELSE 'matrix_sheet' END AS layout
              FROM supplier WHERE s_suppkey % 2 = 0
              UNION ALL
              SELECT n_nationkey + 1000000000000, 'Orphan#' || n_nationkey, '2.0.0', 'text_log' FROM nation)""",
    "v_uploads": """
        SELECT 'part_' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.txt' ELSE '.pmisparser.js' END AS file_name,
               p_partkey AS load_seq, p_partkey % 37 <> 0 AS load_ok, p_partkey % 74 = 0 AS load_fails, p_partkey % 43 = 0 AS is_empty, p_partkey % 31 <> 0 AS has_meta,
               CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN ' bad'
                    WHEN p_partkey % 17 = 0 THEN 'a/b'
                    ELSE 'Supplier#' || lpad(CAST(p_partkey % 150 AS VARCHAR), 9, '0') END AS vendor_key,
               CASE WHEN p_partkey % 47 = 0 THEN 'a/b' WHEN p_partkey % 41 = 0 THEN 'someone else'
                    ELSE 'Supplier#' || lpad(CAST(p_partkey % 150 AS VARCHAR), 9, '0') END AS expected_key,
               CASE WHEN p_partkey % 19 <> 0 THEN '1.' || (p_partkey % 4) END AS version,
               p_type || '、' || p_brand AS target_fields,
               p_partkey % 23 <> 0 AS target_fields_is_list, p_partkey % 29 <> 0 AS has_parse,
               CASE p_partkey % 7 WHEN 0 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'error'
                    WHEN 4 THEN 'not_function' ELSE 'none' END AS self_test,
               CASE WHEN p_partkey % 5 = 0 THEN 'remove' ELSE 'install' END AS op
        FROM part""",
    # Rule messages against an expected key; v_checked uses the reader's own key.
    "v_checked": """
        SELECT *, CASE
            WHEN is_empty THEN '讀取檔內容為空'
            WHEN load_fails THEN '讀取檔無法載入:unexpected token'
            WHEN NOT load_ok THEN '讀取檔未匯出有效內容'
            WHEN NOT has_meta THEN '讀取檔缺少 meta'
            WHEN vendor_key = '' THEN '讀取檔 meta 缺少 vendorKey'
            WHEN vendor_key IN (' bad', 'a/b') THEN '讀取檔 meta.vendorKey 不是合法廠商名稱(空白/含危險字元/過長)'
            WHEN version IS NULL THEN '讀取檔 meta 缺少 version'
            WHEN NOT target_fields_is_list THEN '讀取檔 meta.targetFields 須為陣列'
            WHEN NOT has_parse THEN '讀取檔缺少 parse function'
            WHEN self_test = 'not_function' THEN '讀取檔 selfTest 須為 function'
            WHEN self_test = 'error' THEN '讀取檔 selfTest 執行失敗:boom'
            WHEN self_test = 'false' THEN '讀取檔 selfTest 未通過(內附驗證失敗)' END AS rule_error
        FROM v_uploads""",
    "v_bulk": """
        SELECT file_name,
               CASE WHEN rule_error IS NULL THEN vendor_key END AS vendor_key,
               CASE WHEN rule_error IS NULL THEN m.id END AS matched_vendor_id,
               rule_error IS NULL AND m.id IS NOT NULL AS ok,
               coalesce(rule_error, CASE WHEN m.id IS NULL THEN 'unmatched:查無同名廠商' END) AS error
        FROM v_checked LEFT JOIN (SELECT name, min(id) AS id FROM v_vendors GROUP BY name) m ON m.name = vendor_key""",
    "v_blank_lines": """
        SELECT doc_id, line_no, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(12288) || chr(65279)) AS name
        FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no
              FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS lines FROM documents))""",
    "v_lines": "SELECT * FROM v_blank_lines WHERE length(name) > 0",
    "v_known": """
        SELECT DISTINCT trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(12288) || chr(65279)) AS name
        FROM (SELECT unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM benchmark)""",
    "v_work": """
        SELECT *, day_no * 1000000 + pos // 40 AS day_pos, pos % 40 AS item_pos,
               strftime(DATE '1992-01-01' + CAST(day_no AS INTEGER), '%Y-%m-%d') AS log_date_raw
        FROM (SELECT l_orderkey AS file_id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS day_no,
                     l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linestatus, l_returnflag,
                     row_number() OVER (PARTITION BY l_orderkey, CAST(l_shipdate AS DATE)
                         ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                  l_linestatus, l_returnflag) - 1 AS pos
              FROM lineitem)""",
    "v_items": """
        SELECT file_id, day_no, day_pos, item_pos, log_date_raw, l_linenumber, l_linestatus,
               CAST(l_linenumber AS VARCHAR) AS item_no,
               p_name AS item_name, p_type AS unit, p_retailprice AS unit_price, l_quantity * 10 AS contract_qty,
               l_quantity AS today_qty,
               CASE WHEN l_linestatus <> 'O' THEN l_extendedprice END AS today_amount,
               l_quantity + l_linenumber AS cum_qty
        FROM v_work LEFT JOIN part ON p_partkey = l_partkey""",
    "v_day_totals": """
        SELECT file_id, day_no, day_pos, log_date_raw,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n_items
        FROM v_work GROUP BY ALL""",
    "v_days": """
        SELECT file_id, day_no, day_pos, 'Project ' || file_id AS project_name,
               CASE WHEN (file_id + day_no) % 11 <> 0 THEN log_date_raw END AS log_date_raw,
               CASE WHEN day_no % 2 = 0 THEN '三' END AS weekday,
               CASE WHEN day_no % 3 = 0 THEN '晴' END AS weather_am,
               (day_no % 100) / 4.0::DOUBLE AS actual_pct, cents / 100.0::DOUBLE AS cum_amount
        FROM v_day_totals""",
    "v_subs": """
        SELECT k.project_id || '|' || k.period || '|' || k.type AS submission_id, k.project_id, k.period, k.type,
               CASE WHEN k.type = 'supervision'
                         AND k.period > min(k.period) FILTER (WHERE k.type = 'supervision') OVER (PARTITION BY k.project_id)
                    THEN -1 - k.project_id ELSE k.project_id END AS file_id, v.name AS vendor_name, r.vendor_key AS reader_key,
               CASE WHEN k.project_id % 23 = 0 THEN 'bad file' END AS parse_error
        FROM (SELECT project_id, period, type FROM v_ledger
              UNION SELECT id, strftime(start_date, '%Y-%m'), 'monthly' FROM v_projects) k
        LEFT JOIN v_projects p ON p.id = k.project_id
        LEFT JOIN v_vendors v ON v.id = p.vendor_id
        LEFT JOIN v_readers r ON r.vendor_key = v.name""",
    "v_reportable": """
        SELECT * FROM v_subs WHERE vendor_name IS NOT NULL AND reader_key IS NOT NULL AND parse_error IS NULL""",
    "v_kept": """
        SELECT s.submission_id, s.project_id, s.period, s.type, d.*
        FROM v_subs s JOIN v_days d ON d.file_id = s.file_id
        WHERE s.type = 'supervision' OR substr(d.log_date_raw, 1, 7) = s.period""",
    "v_sheets": """
        SELECT *, CASE WHEN rep = 1 THEN base ELSE base || '_' || rep END AS sheet_name
        FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, base ORDER BY day_pos) AS rep
              FROM (SELECT *, coalesce(substr(log_date_raw, 6, 5),
                           '第' || row_number() OVER (PARTITION BY submission_id ORDER BY day_pos) || '天') AS base
                    FROM v_kept))""",
    "v_report_lines": """
        SELECT s.submission_id, s.project_id, s.period, s.type, s.sheet_name, i.item_pos, i.item_no, i.item_name, i.unit,
               i.unit_price, i.contract_qty, i.today_qty,
               coalesce(i.today_amount,
                        floor(abs(i.unit_price * i.today_qty) * 100 + 0.5 + 2.220446049250313e-16) / 100) AS today_amount,
               i.cum_qty
        FROM v_sheets s JOIN v_reportable r ON r.submission_id = s.submission_id JOIN v_items i ON i.file_id = s.file_id AND i.day_pos = s.day_pos""",
    "v_grid": """
        SELECT vec_id // 16 AS file_id, vec_id % 16 AS row, col, (vec_id % 16 + col) AS place,
               CAST(floor(CAST(x AS DOUBLE) * 1000) AS DOUBLE) AS whole
        FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS col FROM embeddings)""",
    "v_cells": """
        SELECT file_id, row, col,
               CASE WHEN place % 19 <> 0 THEN whole END AS num,
               CASE WHEN place % 19 = 0 THEN 't' || place ELSE CAST(CAST(whole AS BIGINT) AS VARCHAR) END AS text
        FROM v_grid WHERE place % 3 <> 0 AND place % 17 <> 0""",
    "v_matrix": """
        SELECT l_orderkey AS file_id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS day_no,
               l_linenumber, sum(l_quantity) AS qty,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM lineitem GROUP BY ALL""",
    "v_matrix_days": """
        SELECT file_id, day_no, 2 * day_no + 7 AS day_pos, DATE '1992-01-01' + CAST(day_no + 10000 AS INTEGER) AS day,
               CAST(sum(cents) AS BIGINT) AS cents
        FROM v_matrix GROUP BY ALL HAVING day_no % 5 <> 0""",
    "v_matrix_items": """
        SELECT file_id, l_linenumber, row_number() OVER (PARTITION BY file_id ORDER BY l_linenumber) AS seq
        FROM (SELECT DISTINCT l_orderkey AS file_id, l_linenumber FROM lineitem)""",
}


def _names(text: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", text)]


def with_views(body: str) -> str:
    """Put the definitions of all views a statement uses, directly or not, before it."""
    needed: set[str] = set()
    todo = _names(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo.extend(_names(VIEWS[name]))
    if not needed:
        return body.strip()
    text = body.strip()
    # A view that several statements read is made once.
    readers = [text, *[VIEWS[name] for name in needed]]
    shared = {name for name in needed if sum(len(re.findall(rf"\b(?:FROM|JOIN) {name}\b", t)) for t in readers) > 1}
    # A view may only use views listed before it, which is the order of VIEWS.
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in shared else ''}({VIEWS[name]})" for name in VIEWS if name in needed)
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text.removeprefix('WITH RECURSIVE ')}"
    if text.startswith("WITH "):
        return f"WITH {ctes},\n{text.removeprefix('WITH ')}"
    return f"WITH {ctes}\n{text}"
