"""Daily logs as one wide matrix: two rows per day, one column per item.

Quantity and amount columns are two blocks a constant distance apart, and a day's
cumulative row follows its own row. Both alignments are arithmetic on the cell's
address, so one aggregate by (file, day, item) replaces the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cell_date, weekday_name
from ..functions.text import blank_to_null, column_number, strip_project_label, to_number, to_text
from ..operators.cells import Area, at_cell, one_sheet

# Sheet names, rows and columns of the matrix.
MATRIX_SHEET = "so"
HEAD_SHEET = "監造表頭"
FIRST_DAY_ROW = 7
FIRST_SERIAL = 40000
NAME_ROW, UNIT_ROW, PRICE_ROW, QTY_ROW = 4, 1, 2, 6
QTY_BLOCK = ("AI", "BS")
AMOUNT_BLOCK = ("EE", "FO")
TOTAL_COLUMN = "IA"
LABOUR_COLUMNS = {
    "J": "拆除技術工",
    "K": "泥作技術工",
    "L": "水電技術工",
    "M": "裝潢技術工",
    "N": "油漆技術工",
    "O": "一般工",
}
HEADING_ID = "壹"

QTY_START, QTY_END = map(column_number, QTY_BLOCK)
AMOUNT_START, AMOUNT_END = map(column_number, AMOUNT_BLOCK)

# What days and labour read of the matrix, beside the head sheet.
DAY_COLUMNS = ["A", "B", "C", "D", "H", "I", TOTAL_COLUMN]
DAY_AREA = Area(FIRST_DAY_ROW, None, frozenset(map(column_number, DAY_COLUMNS)))
LABOUR_AREA = Area(FIRST_DAY_ROW, None, DAY_AREA.columns | frozenset(map(column_number, LABOUR_COLUMNS)))
# What items read beside the days: their definitions, and the days' quantities and amounts.
HEAD_AREA = Area(min(NAME_ROW, UNIT_ROW, PRICE_ROW, QTY_ROW), FIRST_DAY_ROW - 1, frozenset(range(QTY_START, QTY_END + 1)))
BODY_AREA = Area(FIRST_DAY_ROW, None, frozenset([*range(QTY_START, QTY_END + 1), *range(AMOUNT_START, AMOUNT_END + 1)]))


def _text(column: str) -> Column:
    return to_text(column, error_tokens=True)


def _number(column: str) -> Column:
    return to_number(column)


def _day_row() -> Column:
    return F.col("row") - (F.col("row") - FIRST_DAY_ROW) % 2


def real_days(cells: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Days with a date serial and morning weather; the generated empty days are left out.

    ``more`` names further columns, whose texts in the day's own row are added under their letters.
    """
    fixed = [column_number(c) for c in [*DAY_COLUMNS, *more]]
    used = one_sheet(cells, MATRIX_SHEET).filter((F.col("row") >= FIRST_DAY_ROW) & F.col("col").isin(fixed))
    own = used.withColumn("day_row", _day_row())
    today, following = F.col("row") == F.col("day_row"), F.col("row") > F.col("day_row")

    def pick(column: str, field: str, when: Column) -> Column:
        return F.max(F.when(when & (F.col("col") == column_number(column)), F.col(field)))

    days = own.groupBy("file_id", "day_row").agg(
        pick("A", "num", today).alias("serial"),
        pick("A", "text", today).alias("date_text"),
        pick("B", "text", today).alias("weekday"),
        pick("C", "text", today).alias("weather_am"),
        pick("D", "text", today).alias("weather_pm"),
        pick("H", "text", today).alias("actual_pct"),
        pick("I", "text", today).alias("planned_pct"),
        pick(TOTAL_COLUMN, "text", following).alias("cum_amount"),
        *[pick(c, "text", today).alias(c) for c in more],
    )
    return days.filter((F.col("serial") >= FIRST_SERIAL) & _text("weather_am").isNotNull())


def head_values(cells: DataFrame) -> DataFrame:
    """Project name and contract amount from the head sheet."""
    heads = one_sheet(cells, HEAD_SHEET).groupBy("file_id").agg(
        at_cell(3, "A", "text").alias("name"), at_cell(6, "H", "text").alias("amount")
    )
    name = blank_to_null(strip_project_label(_text("name")))
    return heads.select("file_id", name.alias("project_name"), _number("amount").alias("contract_amount"))


def matrix_days(cells: DataFrame) -> DataFrame:
    days = real_days(cells).join(head_values(cells), "file_id", "left")
    return days.select(
        "file_id",
        F.col("day_row").cast("bigint").alias("day_pos"),
        "project_name",
        cell_date(F.col("serial"), F.col("date_text")).alias("log_date_raw"),
        weekday_name(_number("weekday")).alias("weekday"),
        _text("weather_am").alias("weather_am"),
        _text("weather_pm").alias("weather_pm"),
        _number("planned_pct").alias("planned_pct"),
        _number("actual_pct").alias("actual_pct"),
        F.lit(None).cast("int").alias("worker_total"),
        _number("cum_amount").alias("cum_amount"),
    )


def matrix_items(cells: DataFrame) -> DataFrame:
    """Item definitions: one array per file, at most one entry per column of the block.

    Named columns count 1, 2, …; the heading column carries its own id and no numbers.
    """
    rows = [NAME_ROW, UNIT_ROW, PRICE_ROW, QTY_ROW]
    heads = one_sheet(cells, MATRIX_SHEET).filter(
        F.col("row").isin(rows) & F.col("col").between(QTY_START, QTY_END)
    )

    def pick(row: int) -> Column:
        return F.max(F.when(F.col("row") == row, F.col("text")))

    columns = heads.groupBy("file_id", "col").agg(
        pick(NAME_ROW).alias("item_name"),
        pick(UNIT_ROW).alias("unit"),
        pick(PRICE_ROW).alias("unit_price"),
        pick(QTY_ROW).alias("contract_qty"),
    )
    named = columns.withColumn("item_name", _text("item_name")).filter(F.col("item_name").isNotNull())
    listed = named.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("col", "item_name", "unit", "unit_price", "contract_qty"))).alias("defs")
    )
    has_heading = (F.get("defs", F.lit(0))["col"] == QTY_START).cast("int")
    exploded = listed.select("file_id", has_heading.alias("shift"), F.posexplode("defs").alias("i", "d"))
    heading = F.col("d.col") == QTY_START
    number = (F.col("i") + 1 - F.col("shift")).cast("string")
    return exploded.select(
        "file_id",
        (F.col("d.col") - QTY_START).alias("item_pos"),
        F.when(heading, F.lit(HEADING_ID)).otherwise(number).alias("item_no"),
        F.col("d.item_name").alias("item_name"),
        F.when(~heading, _text("d.unit")).alias("unit"),
        F.when(~heading, _number("d.unit_price")).alias("unit_price"),
        F.when(~heading, _number("d.contract_qty")).alias("contract_qty"),
    )


def matrix_unpivot(cells: DataFrame, heads: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Every item of a file on each of its real days, with quantities and amounts.

    The definitions travel as one short array per file (the block is 37 columns wide),
    so attaching them to the days is a lookup, not a product of two tables. Where ``cells`` are
    those of the days only, ``heads`` and ``values`` hold the cells of the other two areas.
    """
    defs = matrix_items(cells if heads is None else heads).groupBy("file_id").agg(
        F.collect_list(
            F.struct("item_pos", "item_no", "item_name", "unit", "unit_price", "contract_qty")
        ).alias("defs")
    )
    days = real_days(cells).select("file_id", "day_row")
    wanted = days.join(defs, "file_id").select("file_id", "day_row", F.explode("defs").alias("d"))
    wanted = wanted.select("file_id", "day_row", F.col("d.item_pos").alias("item_pos"), "d")

    col = F.col("col")
    in_qty, in_amount = col.between(QTY_START, QTY_END), col.between(AMOUNT_START, AMOUNT_END)
    body = one_sheet(cells if values is None else values, MATRIX_SHEET).filter((F.col("row") >= FIRST_DAY_ROW) & (in_qty | in_amount))
    placed = body.select(
        "file_id",
        _day_row().alias("day_row"),
        F.when(in_qty, col - QTY_START).otherwise(col - AMOUNT_START).alias("item_pos"),
        ((F.col("row") - FIRST_DAY_ROW) % 2 == 0).alias("today"),
        in_qty.alias("is_qty"),
        "text",
    )
    # Wanted rows and cells meet in one grouping instead of a join, so that gathered files stay where they are.
    met = placed.unionByName(wanted, allowMissingColumns=True).groupBy("file_id", "day_row", "item_pos").agg(
        F.first("d", ignorenulls=True).alias("d"),
        F.max(F.when(F.col("today") & F.col("is_qty"), F.col("text"))).alias("today_qty"),
        F.max(F.when(F.col("today") & ~F.col("is_qty"), F.col("text"))).alias("today_amount"),
        F.max(F.when(~F.col("today") & F.col("is_qty"), F.col("text"))).alias("cum_qty"),
    )
    joined = met.filter(F.col("d").isNotNull()).select("file_id", "day_row", "d.*", "today_qty", "today_amount", "cum_qty")
    numeric = F.col("item_pos") > 0
    return joined.select(
        "file_id",
        F.col("day_row").cast("bigint").alias("day_pos"),
        "item_pos", "item_no", "item_name", "unit", "unit_price", "contract_qty",
        F.when(numeric, _number("today_qty")).alias("today_qty"),
        F.when(numeric, _number("today_amount")).alias("today_amount"),
        F.when(numeric, _number("cum_qty")).alias("cum_qty"),
    )


def matrix_labour(cells: DataFrame) -> DataFrame:
    """Headcounts above zero per trade and real day."""
    days = real_days(cells, list(LABOUR_COLUMNS))
    heads = [
        F.struct(F.lit(column_number(c) - column_number("J")).alias("pos"), F.lit(name).alias("trade"), _number(c).alias("headcount"))
        for c, name in LABOUR_COLUMNS.items()
    ]
    each = days.select("file_id", F.col("day_row").cast("bigint").alias("day_pos"), F.explode(F.array(*heads)).alias("h"))
    return each.select("file_id", "day_pos", "h.*").filter(F.col("headcount") > 0)
