"""Daily logs printed as text, one page per day.

A page is one row holding its text, so the whole layout is expressions on that row
and one explode: no shuffle and no ordered window. The item table is cut out of the
text and split where a line opens an item. Only plain regex functions are used; they
stay in generated code, unlike lambdas over arrays of lines. Texts are split at
fixed characters only, as Spark compiles the pattern of a split anew for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import roc_date
from ..functions.text import CJK_ITEM_IDS, UNITS, any_of, blank_to_null, match_group, nfkc, to_number, trim_wide

# Blanks that normalisation leaves as they are, and those of them that do not end a line.
BLANK = r"[\t\n\x0B\f\r \u1680\u2028\u2029\uFEFF]"
GAP = BLANK.replace("\\n", "", 1)

# Anchors printed on the form, as patterns over normalised text.
PROJECT_NAME = rf"工程名稱:{BLANK}*([^\t\n]+?){BLANK}*(?:\t|日期:|\n)"
LOG_DATE = rf"日期:{BLANK}*(\d+){BLANK}*年{BLANK}*(\d+){BLANK}*月{BLANK}*(\d+){BLANK}*日{BLANK}*(星期.)?"
CASE_TOTAL = rf"本案累計金額{BLANK}*([\d,]+\.?\d*)"
DAY_TOTAL = rf"累{BLANK}*計{BLANK}*\(本日完成金額\)[\s\S]*?\({BLANK}*([\d,]+\.?\d*){BLANK}*\)"
HEADING = rf"備{GAP}*註"
FOOTER = rf"[^\n]*?(?:累{GAP}*計{GAP}*\(本日完成金額\)|本案累計金額)|{GAP}*備{GAP}*註:"

TO_HEADING = rf"(?s)\A.*?{HEADING}[^\n]*(?:\n|\z)"
FROM_FOOTER = rf"(?s)\n(?:{FOOTER}).*\z"
CONTINUATION = rf"\n(?!{GAP}*(?:{any_of(CJK_ITEM_IDS)}|\d{{1,2}})(?:{BLANK}|\z))"
NAME_UNIT_REST = rf"^[^ ]+(.*?) ({any_of(UNITS)}|[A-Z]+\d*)(?: (.*))?$"
DATE_FIELDS = ["year", "month", "day", "weekday"]
NUMBER_FIELDS = ["unit_price", "contract_qty", "today_qty", "today_amount", "cum_qty"]


def _normal(pages: DataFrame) -> DataFrame:
    # The wide colon of the labels is all that keeps most pages from being normal; it is a plain one whatever is around it.
    plain = pages.select("file_id", F.col("page").alias("day_pos"), F.replace("text", F.lit("："), F.lit(":")).alias("text"))
    return plain.select("file_id", "day_pos", nfkc("text").alias("text"))


def item_table(text: Column) -> Column:
    """The lines after the first heading line and before the next footer line, each behind a line feed."""
    return F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(text, TO_HEADING, "")), FROM_FOOTER, "")


def item_lines(table: Column) -> Column:
    """One line per item: its opening line and those that continue it, blanks made single spaces.

    The line before the first opening holds what belongs to no item.
    """
    joined = F.regexp_replace(table, CONTINUATION, " ")
    return F.regexp_replace(joined, f"{GAP}+", " ")


def text_log_days(pages: DataFrame) -> DataFrame:
    """Header of each page. Input: file_id, page, text. Days are numbered by page."""
    text = F.col("text")
    found = _normal(pages).select(
        "file_id",
        "day_pos",
        trim_wide(match_group(text, PROJECT_NAME, 1)).alias("project_name"),
        # The whole text is searched once per field; the date's parts are taken apart once, from its short match.
        F.split(F.regexp_replace(F.regexp_extract(text, LOG_DATE, 0), LOG_DATE, "$1\n$2\n$3\n$4"), "\n").alias("date"),
        F.coalesce(match_group(text, CASE_TOTAL, 1), match_group(text, DAY_TOTAL, 1)).alias("total"),
    )
    parts = [blank_to_null(F.get("date", F.lit(i))).alias(name) for i, name in enumerate(DATE_FIELDS)]
    known = found.select("file_id", "day_pos", "project_name", *parts, "total")
    nothing = F.lit(None)
    return known.select(
        "file_id",
        "day_pos",
        "project_name",
        roc_date(F.col("year"), F.col("month"), F.col("day")).alias("log_date_raw"),
        "weekday",
        nothing.cast("string").alias("weather_am"),
        nothing.cast("string").alias("weather_pm"),
        nothing.cast("double").alias("planned_pct"),
        nothing.cast("double").alias("actual_pct"),
        nothing.cast("int").alias("worker_total"),
        to_number("total").alias("cum_amount"),
    )


def text_rows(pages: DataFrame) -> DataFrame:
    """Item rows: name fragments before the first unit are joined, five numbers follow it.

    Without a unit every fragment belongs to the name and the numbers are null.
    """
    tables = _normal(pages).select("file_id", "day_pos", item_table(F.col("text")).alias("table"))
    lines = tables.select("file_id", "day_pos", F.split(item_lines(F.col("table")), "\n").alias("lines"))
    rows = lines.select("file_id", "day_pos", F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("item_pos", "line"))
    key = ["file_id", "day_pos", "item_pos"]
    spaced = rows.select(*key, F.trim("line").alias("flat"))
    # One match per row: name, unit and numbers come back on three lines.
    parts = F.split(F.regexp_replace("flat", NAME_UNIT_REST, "$1\n$2\n$3"), "\n")
    cut = spaced.select(*key, F.substring_index("flat", " ", 1).alias("item_no"), "flat", parts.alias("parts"))
    has_unit = F.size("parts") == 3
    after_id = F.substring(F.col("flat"), F.length("item_no") + 1, F.length("flat"))
    named = cut.select(
        *key,
        "item_no",
        F.when(has_unit, F.get("parts", F.lit(0))).otherwise(after_id).alias("name"),
        F.when(has_unit, F.get("parts", F.lit(1))).alias("unit"),
        F.when(has_unit, F.split(F.get("parts", F.lit(2)), " ")).alias("numbers"),
    )
    return named.select(
        *key,
        "item_no",
        blank_to_null(F.replace(F.col("name"), F.lit(" "), F.lit(""))).alias("item_name"),
        "unit",
        *[to_number(F.get("numbers", F.lit(i))).alias(field) for i, field in enumerate(NUMBER_FIELDS)],
    )
