"""Daily logs as form workbooks: one sheet per day, fixed addresses.

Work is keyed by (file, sheet, row); a sheet's bounds are minima over its rows. Nothing
is joined, so cells that come gathered by file or sheet are not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import cell_date
from ..functions.text import column_number, is_sheet_item_id, to_number, to_text, trim_wide
from ..operators.cells import SHEET, Area, at, listed_values

DAY_SHEET = r"^\((\d+)\)$"
FIRST_ITEM_ROW = 9
FIRST_EXTRA_ROW = 53

# Addresses of the header cells (0-based row, column letters, kind).
HEADER_CELLS = {
    "weather_am": (1, "E", "text"),
    "weather_pm": (1, "I", "text"),
    "date_num": (1, "R", "num"),
    "date_text": (1, "R", "text"),
    "project_name": (2, "C", "text"),
    "planned_pct": (6, "F", "text"),
    "actual_pct": (6, "Q", "text"),
}

# Columns of the item table and of the labour and machine lists.
ITEM_COLUMNS = {
    "item_name": "B",
    "unit": "J",
    "contract_qty": "K",
    "today_qty": "N",
    "cum_qty": "Q",
    "unit_price": "Y",
}
EXTRA_COLUMNS = {"trade": "A", "headcount": "E", "machine": "L", "machine_qty": "O"}
# Every column the layout reads; merged ranges need filling in these only.
USED_COLUMNS = sorted(
    {column_number(c) for c in [*ITEM_COLUMNS.values(), *EXTRA_COLUMNS.values(), *[a[1] for a in HEADER_CELLS.values()]]}
)

# What each reader asks for. Columns A to C, over which the project name is merged, belong to the header.
HEADER_AREA = Area(1, 6, frozenset(column_number(c) for c in ["A", "B", *[a[1] for a in HEADER_CELLS.values()]]))
ITEM_AREA = Area(FIRST_ITEM_ROW, None, frozenset(column_number(c) for c in ["A", *ITEM_COLUMNS.values()]))
EXTRA_AREA = Area(FIRST_EXTRA_ROW, None, frozenset(column_number(c) for c in EXTRA_COLUMNS.values()))

END_ANCHOR = "營造業專業"
SECTION_TITLE = "^[一二三四五六七八九十]、"


def day_cells(cells: DataFrame) -> DataFrame:
    """Cells of the day sheets."""
    return cells.filter(F.col("sheet").rlike(DAY_SHEET))


def day_sheets(sheets: DataFrame) -> DataFrame:
    """The day sheets of each file; ``day_pos`` gives their numeric order and is theirs alone."""
    return _numbered(day_cells(sheets)).select("file_id", "sheet", _day_pos())


def _numbered(sheets: DataFrame) -> DataFrame:
    """Adds the digits of the sheet's name, which its place is made of."""
    return sheets.withColumn("__digits", F.regexp_extract("sheet", DAY_SHEET, 1))


def _day_pos() -> Column:
    """Place of a numbered sheet, one value per sheet name.

    A name that spells its number plainly, up to 18 digits, has the number itself. Names
    with leading zeros, which may repeat a number, come before these, in the order of their
    numbers. Longer ones sort last, by a hash of the name.
    """
    digits = F.col("__digits")
    number = digits.try_cast("bigint")
    padded = number * 32 + F.length(digits) - F.lit(2**62)
    last = F.lit(2**62) + F.shiftrightunsigned(F.xxhash64("sheet"), 2)
    zeros = digits.startswith("0") & (F.length(digits) > 1)
    return F.when(zeros & (F.length(digits) <= 16), padded).when(~zeros & (F.length(digits) <= 18), number).otherwise(last).alias("day_pos")


def form_days(cells: DataFrame, sheets: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """One header per day sheet, also for an empty one; sheets that are not listed are dropped.

    Cells whose merged ranges are not filled come with ``merges``, which must be disjoint. Weekday,
    worker total and cumulative amount do not exist in this layout.
    """
    ranges = None if merges is None else day_cells(merges)
    values = _numbered(listed_values(day_cells(cells), day_cells(sheets), ranges, HEADER_CELLS))
    nothing = F.lit(None)
    return values.select(
        "file_id",
        _day_pos(),
        to_text("project_name").alias("project_name"),
        cell_date(F.col("date_num"), F.col("date_text")).alias("log_date_raw"),
        nothing.cast("string").alias("weekday"),
        to_text("weather_am").alias("weather_am"),
        to_text("weather_pm").alias("weather_pm"),
        to_number("planned_pct").alias("planned_pct"),
        to_number("actual_pct").alias("actual_pct"),
        nothing.cast("int").alias("worker_total"),
        nothing.cast("double").alias("cum_amount"),
    )


def form_items(cells: DataFrame) -> DataFrame:
    """Item rows from row 10 down to the end of the table.

    The first anchor ends the table, and so does the first other text below some item.
    Cells are gone through once: they become rows, and the two ends are minima over the
    rows of a sheet, which a workbook limits to 1,048,576.
    """
    columns = [column_number(c) for c in ["A", *ITEM_COLUMNS.values()]]
    used = cells.filter((F.col("row") >= FIRST_ITEM_ROW) & F.col("col").isin(columns))
    rows = day_cells(used).groupBy(*SHEET, "row").agg(
        at("A", "num").alias("id_num"),
        at("A", "text").alias("id_text"),
        *[at(letters, "text").alias(name) for name, letters in ITEM_COLUMNS.items()],
    )
    shown = trim_wide("id_text")
    marked = rows.filter(shown != "").withColumn("is_item", is_sheet_item_id(F.col("id_num"), F.col("id_text")))
    marked = marked.withColumn("is_anchor", shown.startswith(END_ANCHOR))
    sheet = Window.partitionBy(*SHEET)
    row = F.col("row")
    bounded = marked.withColumn("first_item", F.min(F.when(F.col("is_item"), row)).over(sheet))
    ends = F.col("is_anchor") | (~F.col("is_item") & (row > F.col("first_item")))
    bounded = bounded.withColumn("stop", F.min(F.when(ends, row)).over(sheet))
    items = bounded.filter(F.col("is_item") & (F.col("stop").isNull() | (row < F.col("stop"))))
    return _numbered(items).select(
        "file_id",
        _day_pos(),
        (F.col("row") - FIRST_ITEM_ROW).alias("item_pos"),
        trim_wide("id_text").alias("item_no"),
        to_text("item_name").alias("item_name"),
        to_text("unit").alias("unit"),
        to_number("unit_price").alias("unit_price"),
        to_number("contract_qty").alias("contract_qty"),
        to_number("today_qty").alias("today_qty"),
        F.lit(None).cast("double").alias("today_amount"),
        to_number("cum_qty").alias("cum_qty"),
    )


def form_extras(cells: DataFrame) -> DataFrame:
    """Labour and machine rows from row 54 down to the next section title.

    Output: file_id, day_pos, row, trade, headcount, machine, machine_qty; a row has a
    trade, a machine, or both.
    """
    columns = [column_number(c) for c in EXTRA_COLUMNS.values()]
    used = cells.filter((F.col("row") >= FIRST_EXTRA_ROW) & F.col("col").isin(columns))
    rows = day_cells(used).groupBy(*SHEET, "row").agg(*[at(c, "text").alias(n) for n, c in EXTRA_COLUMNS.items()])
    rows = rows.withColumn("trade", to_text("trade")).withColumn("machine", to_text("machine"))
    title = F.when(F.col("trade").rlike(SECTION_TITLE), F.col("row"))
    stops = rows.withColumn("stop", F.min(title).over(Window.partitionBy(*SHEET)))
    kept = stops.filter(F.col("stop").isNull() | (F.col("row") < F.col("stop")))
    headcount = to_number("headcount")
    is_labour = ~F.col("trade").contains("、") & headcount.isNotNull()
    out = _numbered(kept).select(
        "file_id",
        _day_pos(),
        "row",
        F.when(is_labour, F.col("trade")).alias("trade"),
        F.when(is_labour, headcount).alias("headcount"),
        "machine",
        F.when(F.col("machine").isNotNull(), to_number("machine_qty")).alias("machine_qty"),
    )
    return out.filter(F.col("trade").isNotNull() | F.col("machine").isNotNull())
