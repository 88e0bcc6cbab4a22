"""One query per scalar function, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..sources.lists import import_lines
from ..sources.star_views import lit_case
from .registry import query

EPS = "2.220446049250313e-16"


def _orders(v):
    return v.table("orders").withColumn("k", F.col("o_orderkey"))


# Numbers ---------------------------------------------------------------------


@query(
    "fn_round_half_up",
    f"""
    SELECT l_orderkey, l_linenumber, v,
           CASE WHEN v < 0 THEN -floor(abs(v) * 100 + 0.5 + {EPS}) ELSE floor(abs(v) * 100 + 0.5 + {EPS}) END / 100 + 0.0 AS two_places,
           CASE WHEN v < 0 THEN -floor(abs(v) + 0.5 + {EPS}) ELSE floor(abs(v) + 0.5 + {EPS}) END + 0.0 AS whole
    FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * (l_discount - CAST(0.05 AS DOUBLE)) AS v FROM lineitem)""",
)
def fn_round_half_up(v):
    value = F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))
    return v.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        value.alias("v"),
        numbers.round_half_up(value, 2).alias("two_places"),
        numbers.round_half_up(value).alias("whole"),
    )


@query(
    "fn_amount_fill",
    f"""
    SELECT file_id, day_pos, item_pos,
           coalesce(today_amount, floor(abs(unit_price * today_qty) * 100 + 0.5 + {EPS}) / 100) AS amount
    FROM v_items""",
)
def fn_amount_fill(v):
    amount = numbers.filled_amount("today_amount", "unit_price", "today_qty")
    return v.items.select("file_id", "day_pos", "item_pos", amount.alias("amount"))


@query(
    "fn_to_num",
    """
    SELECT o_orderkey, CASE o_orderkey % 9
        WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 0.5 WHEN 4 THEN 1000.0
        WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN CAST(o_custkey AS DOUBLE) ELSE o_totalprice END AS number
    FROM orders""",
)
def fn_to_num(v):
    k = F.col("k")
    raw = lit_case(
        k % 9,
        {
            0: "1d",
            1: "Infinity",
            2: " － ",
            3: ".5",
            4: "　1e3 ",
            5: "#REF!",
            6: F.lit(None).cast("string"),
            7: F.concat(F.col("o_custkey").cast("string"), F.lit(".")),
        },
        F.format_number("o_totalprice", 2),
    )
    return _orders(v).select("o_orderkey", text.to_number(raw).alias("number"))


@query(
    "fn_progress",
    "SELECT l_orderkey, l_linenumber, l_discount AS progress FROM lineitem",
)
def fn_progress(v):
    """Progress fractions stay fractions: no percent scaling."""
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", text.to_number(F.col("l_discount").cast("string")).alias("progress")
    )


# Marks and texts -------------------------------------------------------------

_MARKS = {
    0: "",
    1: " - ",
    2: "–",
    3: "　—",
    4: "－",
    5: "#VALUE!",
    6: "$AAA",
    7: "aa",
    8: None,
    9: "a",
}


def _mark(k):
    values = {i: (F.lit(None).cast("string") if m is None else m) for i, m in _MARKS.items()}
    return lit_case(k % 11, values, F.concat(F.lit(" x"), k.cast("string"), F.lit("　")))


@query("fn_no_data", "SELECT o_orderkey, o_orderkey % 11 IN (0, 1, 2, 3, 4, 8) AS no_data FROM orders")
def fn_no_data(v):
    return _orders(v).select("o_orderkey", text.is_no_data(_mark(F.col("k"))).alias("no_data"))


@query("fn_error_token", "SELECT o_orderkey, o_orderkey % 11 IN (5, 6, 7) AS error_token FROM orders")
def fn_error_token(v):
    return _orders(v).select("o_orderkey", text.is_error_token(_mark(F.col("k"))).alias("error_token"))


@query(
    "fn_to_str",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 10 THEN 'x' || o_orderkey WHEN o_orderkey % 11 = 9 THEN 'a' END AS strict,
           CASE o_orderkey % 11 WHEN 10 THEN 'x' || o_orderkey WHEN 9 THEN 'a' WHEN 5 THEN '#VALUE!' WHEN 6 THEN '$AAA'
                WHEN 7 THEN 'aa' END AS plain
    FROM orders""",
)
def fn_to_str(v):
    mark = _mark(F.col("k"))
    return _orders(v).select(
        "o_orderkey", text.to_text(mark, error_tokens=True).alias("strict"), text.to_text(mark).alias("plain")
    )


@query(
    "fn_item_id",
    """
    SELECT o_orderkey, o_orderkey % 1000 < 100 OR o_orderkey % 7 = 0 AS page_id,
           o_orderkey % 7 = 0 OR o_orderkey % 3 <> 0 OR o_orderkey % 1000 > 0 AS sheet_id
    FROM orders""",
)
def fn_item_id(v):
    k = F.col("k")
    digits = (k % 1000).cast("string")
    token = F.when(k % 7 == 0, F.lit("拾")).otherwise(digits)
    num = F.when((k % 7 != 0) & (k % 3 == 0), (k % 1000).cast("double"))
    return _orders(v).select(
        "o_orderkey",
        text.is_page_item_id(token).alias("page_id"),
        text.is_sheet_item_id(num, token).alias("sheet_id"),
    )


@query(
    "fn_unit_token",
    """
    SELECT doc_id, len(tokens) AS n_tokens, len(list_filter(tokens, lambda t: regexp_full_match(t, '[A-Z]+[0-9]*'))) AS n_units,
           len(list_filter(tokens, lambda t: regexp_full_match(t, '[0-9]{1,2}'))) AS n_ids
    FROM (SELECT doc_id, string_split(text, ' ') AS tokens FROM documents)""",
)
def fn_unit_token(v):
    tokens = F.split("text", " ")
    return v.documents.select(
        "doc_id",
        F.size(tokens).cast("bigint").alias("n_tokens"),
        F.size(F.filter(tokens, text.is_unit)).cast("bigint").alias("n_units"),
        F.size(F.filter(tokens, text.is_page_item_id)).cast("bigint").alias("n_ids"),
    )


@query("fn_nfkc", "SELECT doc_id, text FROM documents")
def fn_nfkc(v):
    """Documents written in full-width letters come back as they were."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    wide = "".join(chr(ord(c) + 0xFEE0) for c in letters)
    return v.documents.select("doc_id", text.nfkc(F.translate("text", letters, wide)).alias("text"))


@query("fn_strip_label", "SELECT id, CASE WHEN id % 4 <> 0 THEN name END AS name FROM v_projects")
def fn_strip_label(v):
    label = lit_case(F.col("id") % 3, {0: "工程名稱:", 1: "工程名稱　： "}, "")
    name = F.when(F.col("id") % 4 == 0, F.lit("工程名稱:")).otherwise(F.concat(label, "name"))
    return v.projects.select("id", text.strip_project_label(name).alias("name"))


@query(
    "fn_safe_sheet_name",
    """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Day' ELSE substr(replace(p_name, ' ', '-') || '-' || p_brand || '------------------------', 1, 31) END AS sheet_name
    FROM part""",
)
def fn_safe_sheet_name(v):
    raw = F.concat(F.translate("p_name", " ", "/"), F.lit(":"), "p_brand", F.lit("[]*?\\/[]*?\\/[]*?\\/[]*?\\/"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit(" 　")).otherwise(raw)
    return v.table("part").select("p_partkey", text.safe_sheet_name(name, F.lit("Day")).alias("sheet_name"))


@query(
    "fn_safe_file_name",
    """SELECT doc_id, regexp_replace(text, '[\\\\/:*?"<>|]', '_', 'g') AS name FROM documents""",
)
def fn_safe_file_name(v):
    """Whole documents as names that arrive as latin1 bytes of UTF-8 text."""
    sent = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return v.documents.select("doc_id", text.safe_file_name(text.reread_latin1_as_utf8(sent)).alias("name"))


@query(
    "fn_vendor_key",
    """
    SELECT doc_id, line_no, length(name) BETWEEN 1 AND 100 AND NOT regexp_matches(name, '[\\\\/:*?"<>|\\x00-\\x1f]')
           AND name NOT IN ('.', '..') AS valid
    FROM v_lines""",
)
def fn_vendor_key(v):
    lines = import_lines(v.documents, "doc_id", "text")
    return lines.select("doc_id", "line_no", text.is_vendor_key("name").alias("valid"))


@query(
    "fn_path_inside",
    """
    SELECT o_orderkey, o_orderkey % 10 IN (0, 3, 7) AS inside FROM orders""",
)
def fn_path_inside(v):
    key = F.col("k").cast("string")
    path = lit_case(
        F.col("k") % 10,
        {
            0: F.concat(F.lit("uploads/proj_"), key, F.lit("/x.pdf")),
            1: "../secret.txt",
            2: F.concat(F.lit("uploads/../../"), key),
            3: F.concat(F.lit("uploads/../output/./"), key),
            4: F.concat(F.lit("/etc/"), key),
            5: "",
            6: F.lit(None).cast("string"),
            7: F.concat(key, F.lit("/a//../b")),
            8: F.concat(key, F.lit("/..")),
        },
        F.concat(F.lit("..hidden"), key),
    )
    return _orders(v).select("o_orderkey", text.is_inside_root(path).alias("inside"))


@query(
    "fn_column_letters",
    """
    SELECT o_orderkey, CASE WHEN n <= 26 THEN chr(CAST(65 + (n - 1) % 26 AS INTEGER))
        WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
        WHEN n <= 18278 THEN chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 27) // 26 % 26 AS INTEGER))
             || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
        WHEN n <= 475254 THEN chr(CAST(65 + (n - 18279) // 17576 AS INTEGER)) || chr(CAST(65 + (n - 703) // 676 % 26 AS INTEGER))
             || chr(CAST(65 + (n - 27) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
        END AS letters
    FROM (SELECT o_orderkey, o_orderkey % 475254 + 1 AS n FROM orders)""",
)
def fn_column_letters(v):
    return _orders(v).select("o_orderkey", text.column_letters(F.col("k") % 475254).alias("letters"))


@query("fn_column_index", "SELECT o_orderkey, o_orderkey AS idx FROM orders")
def fn_column_index(v):
    """Indexes written as letters and read back, in either case."""
    letters = text.column_letters("k")
    cased = F.when(F.col("k") % 2 == 0, F.lower(letters)).otherwise(letters)
    return _orders(v).select("o_orderkey", text.column_index(cased).alias("idx"))


# Dates -----------------------------------------------------------------------


@query(
    "fn_deadline",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_linenumber < 7 THEN strftime(l_shipdate, '%Y-%m') || '-' ||
                lpad(CAST(least(greatest(CASE WHEN l_partkey % 40 - 5 = 0 THEN 1 ELSE l_partkey % 40 - 5 END, 1), 28) AS VARCHAR), 2, '0')
           END AS deadline
    FROM lineitem""",
)
def fn_deadline(v):
    period = F.when(F.col("l_linenumber") < 7, F.date_format("l_shipdate", "yyyy-MM")).otherwise(
        F.date_format("l_shipdate", "yyyy/MM")
    )
    day = dates.deadline(period, F.col("l_partkey") % 40 - 5)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", day.alias("deadline"))


@query(
    "fn_period",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_of_time,
           CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS month_of_text
    FROM orders""",
)
def fn_period(v):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    spoiled = F.when(F.col("k") % 3 != 0, iso).otherwise(F.concat(iso, F.lit("T00")))
    return _orders(v).select(
        "o_orderkey", dates.month_of("o_orderdate").alias("month_of_time"), dates.period_of(spoiled).alias("month_of_text")
    )


@query(
    "fn_pad2",
    "SELECT o_orderkey, lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS two FROM orders",
)
def fn_pad2(v):
    return _orders(v).select("o_orderkey", dates.pad2(F.col("k") % 60).alias("two"))


@query(
    "fn_excel_date",
    """
    SELECT o_orderkey, CASE WHEN n < 0 OR n > 2958465 THEN NULL WHEN floor(n) = 60 THEN '1900-02-29' WHEN floor(n) = 0 THEN '1900-01-00'
        WHEN n < 60 THEN strftime(DATE '1899-12-31' + CAST(floor(n) AS INTEGER), '%Y-%m-%d')
        ELSE strftime(DATE '1899-12-30' + CAST(floor(n) AS INTEGER), '%Y-%m-%d') END AS day
    FROM (SELECT o_orderkey, o_orderkey * CAST(3.25 AS DOUBLE) - 10 AS n FROM orders)""",
)
def fn_excel_date(v):
    return _orders(v).select("o_orderkey", dates.excel_date(F.col("k") * F.lit(3.25) - 10).alias("day"))


@query("fn_roc_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def fn_roc_date(v):
    parts = [(F.year("o_orderdate") - 1911), F.month("o_orderdate"), F.dayofmonth("o_orderdate")]
    return _orders(v).select("o_orderkey", dates.roc_date(*[p.cast("string") for p in parts]).alias("day"))


def _written_date():
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    ys, ms, ds = y.cast("string"), m.cast("string"), d.cast("string")
    roc = (y - 1911).cast("string")
    return lit_case(
        F.col("k") % 6,
        {
            0: F.concat(F.lit("民國 "), roc, F.lit(" 年　"), ms, F.lit("月 "), ds, F.lit(" 日")),
            1: F.concat(ys, F.lit("年"), ms, F.lit("月"), ds, F.lit("日")),
            2: F.concat(F.lit("on "), ys, F.lit("/"), ms, F.lit("-"), ds, F.lit(" at noon")),
            3: F.concat(F.lit(" "), ms, F.lit("."), ds, F.lit("/"), F.lit("26　")),
            4: F.concat(ms, F.lit("/"), ds),
        },
        F.concat(ys, F.lit("-13-45")),
    )


_WRITTEN = """CASE o_orderkey % 6 WHEN 3 THEN '2026' || strftime(o_orderdate, '-%m-%d') WHEN 4 THEN NULL
    WHEN 5 THEN strftime(o_orderdate, '%Y') || '-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END"""


@query("fn_date_string", f"SELECT o_orderkey, {_WRITTEN} AS day FROM orders")
def fn_date_string(v):
    return _orders(v).select("o_orderkey", dates.date_text(_written_date()).alias("day"))


@query(
    "fn_cell_date",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE {_WRITTEN} END AS day FROM orders",
)
def fn_cell_date(v):
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("double")
    num = F.when(F.col("k") % 2 == 0, serial)
    return _orders(v).select("o_orderkey", dates.cell_date(num, _written_date()).alias("day"))


@query(
    "fn_weekday",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 BETWEEN 1 AND 7
        THEN ['日', '一', '二', '三', '四', '五', '六'][CAST(o_orderkey % 10 AS INTEGER)] END AS weekday
    FROM orders""",
)
def fn_weekday(v):
    return _orders(v).select("o_orderkey", dates.weekday_name(F.col("k") % 10).alias("weekday"))


@query(
    "fn_date_weekday",
    """
    SELECT o_orderkey, trim(strftime(o_orderdate, '%Y-%m-%d') || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN '(五)' ELSE '' END) AS shown
    FROM orders""",
)
def fn_date_weekday(v):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    weekday = lit_case(F.col("k") % 3, {0: "五", 1: ""}, F.lit(None).cast("string"))
    return _orders(v).select("o_orderkey", dates.date_with_weekday(day, weekday).alias("shown"))
