"""Workbook cells as a long table: cleaning, merged ranges, fixed addresses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column_number, number_as_text

SHEET = ["file_id", "sheet"]
CELL = [*SHEET, "row", "col"]
SIZE = ["origin_row", "origin_col", "n_rows", "n_cols"]


@dataclass(frozen=True)
class Area:
    """The part of a sheet that a reader asks for: its rows, both ends included, and its columns.

    Whoever makes cells may leave out those that cannot lie in the area; readers filter by address all the same.
    """

    first: int
    last: int | None
    columns: frozenset[int]

    def holds_rows(self, first: int, last: int) -> bool:
        """Whether some row from ``first`` to ``last`` may be asked for."""
        return last >= self.first and (self.last is None or first <= self.last)


def clean_cells(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Non-empty cells with addresses relative to the sheet's origin.

    Error cells hold a code that looks like a number, so they become empty; a boolean is
    the text true or false and no number. Output: file_id, sheet, row, col, num, text
    (text also spells numbers).
    """
    good = cells.filter(F.coalesce(F.col("cell_type") != "e", F.lit(True)))
    good = good.filter(F.col("num_value").isNotNull() | F.col("str_value").isNotNull())
    row, col = F.col("row"), F.col("col")
    if sheets is not None:
        good = good.join(sheets.select(*SHEET, "origin_row", "origin_col"), SHEET)
        row, col = row - F.col("origin_row"), col - F.col("origin_col")
    truth = F.coalesce(F.col("cell_type") == "b", F.lit(False)) & F.col("num_value").isNotNull()
    num = F.when(F.col("str_value").isNull() & ~truth, F.col("num_value"))
    spelled = F.when(truth, (F.col("num_value") != 0).cast("string")).otherwise(number_as_text(num))
    return good.select(
        *SHEET,
        row.alias("row"),
        col.alias("col"),
        num.alias("num"),
        F.coalesce("str_value", spelled).alias("text"),
    )


def one_sheet(cells: DataFrame, sheet: str) -> DataFrame:
    return cells.filter(F.col("sheet") == sheet)


def _clipped(merges: DataFrame, sheets: DataFrame) -> DataFrame:
    """Merged ranges relative to the origin and cut at the sheet's edge; a start outside drops the range."""
    size = sheets.select(*SHEET, "origin_row", "origin_col", "n_rows", "n_cols")
    m = merges.join(size, SHEET).select(
        *SHEET,
        "merge_seq",
        (F.col("r0") - F.col("origin_row")).alias("r0"),
        (F.col("c0") - F.col("origin_col")).alias("c0"),
        F.least(F.col("r1") - F.col("origin_row"), F.col("n_rows") - 1).alias("r1"),
        F.least(F.col("c1") - F.col("origin_col"), F.col("n_cols") - 1).alias("c1"),
    )
    return m.filter((F.col("r0") >= 0) & (F.col("c0") >= 0) & (F.col("r0") <= F.col("r1")) & (F.col("c0") <= F.col("c1")))


def _covered(ranges: DataFrame, columns: Sequence[int] | None) -> DataFrame:
    """One row per covered cell, of the named columns only; rows and columns are generated in two steps."""
    rows = ranges.withColumn("row", F.explode(F.sequence("r0", "r1")))
    span = F.sequence("c0", "c1")
    if columns is not None:
        span = F.filter(F.array(*[F.lit(c) for c in sorted(set(columns))]), lambda c: c.between(F.col("c0"), F.col("c1")))
    return rows.withColumn("col", F.explode(span))


def _with_inherited_starts(started: DataFrame) -> DataFrame:
    """Give a value to ranges whose empty start cell lies inside an earlier range.

    Ranges apply in order, so such a start takes the value of the first earlier range
    that covers it and has one. The ranges of a sheet, a few thousand at most, are gone
    through once in their order, each looking back at those that are settled.
    """
    fields = ["merge_seq", "r0", "c0", "r1", "c1", "num", "text"]
    ranges = F.array_sort(F.collect_list(F.struct(*fields)))

    def settle(settled: Column, x: Column) -> Column:
        covers = F.filter(
            settled,
            lambda e: e["text"].isNotNull() & x["r0"].between(e["r0"], e["r1"]) & x["c0"].between(e["c0"], e["c1"]),
        )
        first = F.get(covers, F.lit(0))
        inherited = x.withField("num", first["num"]).withField("text", first["text"])
        return F.concat(settled, F.array(F.when(x["text"].isNotNull(), x).otherwise(inherited)))

    types = {f.name: f.dataType.simpleString() for f in started.schema.fields}
    empty = F.array().cast("array<struct<" + ",".join(f"{f}:{types[f]}" for f in fields) + ">>")
    per_sheet = started.groupBy(*SHEET).agg(ranges.alias("ranges"))
    waiting = F.exists("ranges", lambda x: x["text"].isNull())
    settled = F.when(waiting, F.aggregate("ranges", empty, settle)).otherwise(F.col("ranges"))
    return per_sheet.select(*SHEET, F.explode(settled).alias("m")).select(*SHEET, "m.*")


def _filled_by_disjoint(held: DataFrame, ranges: DataFrame, columns: Sequence[int] | None) -> DataFrame:
    """The empty cells of disjoint ranges with their range's start value.

    A range is laid out with its start; one grouping by address brings cells and ranges
    together, a window over each range carries the start's value. Nothing is joined, so
    cells gathered by file or sheet stay where they are.
    """
    rows = ranges.withColumn("row", F.explode(F.sequence("r0", "r1")))
    span = F.sequence("c0", "c1")
    if columns is not None:
        span = F.filter(F.array(*[F.lit(c) for c in sorted(set(columns))]), lambda c: c.between(F.col("c0"), F.col("c1")))
        span = F.array_distinct(F.concat(F.array(F.col("c0").cast("int")), span))
    laid = rows.withColumn("col", F.explode(span)).select(*CELL, F.struct("merge_seq", "r0", "c0").alias("m"))
    both = held.unionByName(laid, allowMissingColumns=True)
    met = both.groupBy(*CELL).agg(F.max("own_num").alias("own_num"), F.max("own_text").alias("own_text"), F.max("m").alias("m")).filter(F.col("m").isNotNull())
    placed = met.select(*CELL, "own_num", "own_text", "m.*")
    range_ = Window.partitionBy(*SHEET, "merge_seq")
    is_start = (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))
    carried = placed.withColumns({f: F.max(F.when(is_start, F.col(f"own_{f}"))).over(range_) for f in ("num", "text")})
    empty = carried.filter(F.col("own_text").isNull() & F.col("own_num").isNull() & F.col("text").isNotNull())
    if columns is not None:
        empty = empty.filter(F.col("col").isin(list(columns)))
    return empty.select(*CELL, "num", "text")


def merge_fill(
    cells: DataFrame,
    sheets: DataFrame,
    merges: DataFrame,
    overlapping: bool = True,
    columns: Sequence[int] | None = None,
) -> DataFrame:
    """Copy the start value of each merged range to its empty cells.

    Cells that hold a value keep it and go straight to the result; beside that they are
    shuffled once, by address, to be met by the starts of ranges and by the covered cells.
    Where ranges overlap the earliest one wins. With ``overlapping=False`` the caller
    vouches that ranges are disjoint, as the workbook format requires, and the look for
    starts inside other ranges is skipped, and nothing is joined. ``columns`` names the columns a layout reads;
    others are dropped before the work.
    """
    ranges = _clipped(merges, sheets).withColumns({"row": F.col("r0"), "col": F.col("c0")})
    # Both joins read the very same rows and columns, so that they share one shuffle of the cells.
    held = cells.filter((F.col("row") >= 0) & (F.col("col") >= 0)).select(*CELL, F.col("num").alias("own_num"), F.col("text").alias("own_text"))
    own = cells.select(*CELL, "num", "text")
    if columns is not None:
        own = own.filter(F.col("col").isin(list(columns)))
    if not overlapping:
        return own.unionByName(_filled_by_disjoint(held, ranges, columns))
    started = ranges.join(held, CELL, "left").select(
        *SHEET, "merge_seq", "r0", "c0", "r1", "c1", F.col("own_num").alias("num"), F.col("own_text").alias("text")
    )
    started = _with_inherited_starts(started)
    covered = _covered(started.filter(F.col("text").isNotNull()), columns)
    empty = covered.join(held, CELL, "left").filter(F.col("own_text").isNull() & F.col("own_num").isNull())
    first = empty.groupBy(*CELL).agg(F.min_by(F.struct("num", "text"), "merge_seq").alias("v"))
    return own.unionByName(first.select(*CELL, "v.num", "v.text"))


def at(col: str | int, field: str) -> Column:
    """Value of one column within a group of cells: ``text`` or ``num``."""
    index = column_number(col) if isinstance(col, str) else col
    return F.max(F.when(F.col("col") == index, F.col(field)))


def at_cell(row: int, col: str, field: str) -> Column:
    """Value at a fixed address within a group of cells."""
    return F.max(F.when((F.col("row") == row) & (F.col("col") == column_number(col)), F.col(field)))


def sheet_values(cells: DataFrame, addresses: Mapping[str, tuple[int, str, str]]) -> DataFrame:
    """One row per sheet with a column for each named (row, column letters, field)."""
    rows = sorted({row for row, _, _ in addresses.values()})
    cols = sorted({column_number(col) for _, col, _ in addresses.values()})
    used = cells.filter(F.col("row").isin(rows) & F.col("col").isin(cols))
    return used.groupBy(*SHEET).agg(*[at_cell(r, c, f).alias(name) for name, (r, c, f) in addresses.items()])


def listed_values(cells: DataFrame, sheets: DataFrame, merges: DataFrame | None, addresses: Mapping[str, tuple[int, str, str]]) -> DataFrame:
    """As :func:`sheet_values`, one row per listed sheet, also for an empty one, with disjoint merged ranges filled.

    Cells, sizes and ranges of a sheet meet in one grouping and nothing is joined, so what comes
    gathered by file stays where it is. The starts that can fill an address lie in the corner of
    the sheet that the addresses span, so few cells are collected.
    """
    at_ = {name: (row, column_number(col), field) for name, (row, col, field) in addresses.items()}
    places = sorted({(row, col) for row, col, _ in at_.values()})
    if merges is None:
        near = cells.filter(F.col("row").isin([r for r, _ in places]) & F.col("col").isin([c for _, c in places]))
    else:
        near = cells.filter(F.col("row").between(0, max(r for r, _ in places)) & F.col("col").between(0, max(c for _, c in places)))
    cell = F.struct("row", "col", "num", "text").alias("cell")
    both = near.select(*SHEET, cell).unionByName(sheets.select(*SHEET, F.struct(*SIZE).alias("size")), allowMissingColumns=True)
    if merges is not None:
        ranges = merges.filter(F.col("file_id").isNotNull()).select(*SHEET, F.struct("r0", "c0", "r1", "c1").alias("range"))
        both = both.unionByName(ranges, allowMissingColumns=True)

    def own(row: int, col: int, field: str) -> Column:
        return F.max(F.when((F.col("cell.row") == row) & (F.col("cell.col") == col), F.col(f"cell.{field}")))

    gathered = [] if merges is None else [F.collect_list("cell").alias("cells"), F.collect_list("range").alias("ranges")]
    # Whatever has a number has a text, so the text tells whether a cell is empty.
    wanted = sorted({(r, c, f) for r, c, f in at_.values()} | {(r, c, "text") for r, c in places})
    values = [own(r, c, f).alias(f"{f}_{r}_{c}") for r, c, f in wanted]
    met = both.groupBy(*SHEET).agg(F.first("size", ignorenulls=True).alias("size"), *values, *gathered).filter(F.col("size").isNotNull())
    if merges is None:
        return met.select(*SHEET, *[F.col(f"{f}_{r}_{c}").alias(name) for name, (r, c, f) in at_.items()])

    size = {field: F.col(f"size.{field}") for field in SIZE}

    def reaches(row: int, col: int) -> Column:
        """The start of the range, cut at the sheet's edge, over an address."""

        def over(m: Column) -> Column:
            r0, c0 = m["r0"] - size["origin_row"], m["c0"] - size["origin_col"]
            inside = (F.lit(row) < size["n_rows"]) & (F.lit(col) < size["n_cols"]) & (r0 >= 0) & (c0 >= 0)
            return inside & (r0 <= row) & (c0 <= col) & (m["r1"] - size["origin_row"] >= row) & (m["c1"] - size["origin_col"] >= col)

        return F.get(F.filter("ranges", over), F.lit(0))

    def start(row: int, col: int) -> Column:
        return F.when(F.col(f"text_{row}_{col}").isNull() & (F.size("ranges") > 0), reaches(row, col)).alias(f"start_{row}_{col}")

    started = met.select("*", *[start(r, c) for r, c in places])

    def filled(row: int, col: int, field: str) -> Column:
        begin = F.col(f"start_{row}_{col}")
        here = F.filter("cells", lambda x: (x["row"] == begin["r0"] - size["origin_row"]) & (x["col"] == begin["c0"] - size["origin_col"]))
        # A start without a text fills nothing.
        held = F.when(F.exists(here, lambda x: x["text"].isNotNull()), F.array_max(F.transform(here, lambda x: x[field])))
        return F.coalesce(F.col(f"{field}_{row}_{col}"), F.when(begin.isNotNull(), held))

    return started.select(*SHEET, *[filled(r, c, f).alias(name) for name, (r, c, f) in at_.items()])
