"""Every file goes to the layout of its vendor's reader; results are one common schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import CELL, SHEET, Area
from ..operators.nesting import nest_kinds
from ..schemas import DAY_FIELDS, ITEM_FIELDS
from ..session import shared_folder
from ..sources.lists import installed_readers
from . import form_sheet, matrix_sheet, text_log

DAY_KEY = ["file_id", "day_pos"]


@dataclass(frozen=True)
class FileInputs:
    """Tables a layout may read: filled cells, sheet list, page texts.

    A table that carries a ``layout`` column (stored partitioned by it, which is known at
    upload) is pruned by a filter; any other table is joined to the list of files. Where
    the cells of a form can be had area by area, ``form_area`` gives them (of sound form files
    only), and the form layout makes no cells it does not read. Merged ranges of forms whose
    header cells are not filled are ``form_merges``, which must be disjoint and end above the items.
    ``matrix_area`` gives the cells of a matrix in the same way.
    """

    cells: DataFrame
    sheets: DataFrame
    pages: DataFrame
    form_area: Callable[[Area], DataFrame] | None = None
    form_merges: DataFrame | None = None
    matrix_area: Callable[[Area], DataFrame] | None = None

    def form_cells(self, area: Area) -> DataFrame:
        return self.cells if self.form_area is None else self.form_area(area)

    def matrix_cells(self, area: Area) -> DataFrame:
        return self.cells if self.matrix_area is None else self.matrix_area(area)

    def of(self, files: DataFrame, layout: str) -> FileInputs:
        ids = files.filter(F.col("layout") == layout).select("file_id")

        def part(table: DataFrame) -> DataFrame:
            if "layout" in table.columns:
                return table.filter(F.col("layout") == layout).drop("layout")
            return table.join(ids, "file_id", "left_semi")

        return FileInputs(part(self.cells), part(self.sheets), part(self.pages), self.form_area, self.form_merges, self.matrix_area)


def cells_of(table: DataFrame, files: DataFrame, layout: str) -> DataFrame:
    """The rows of the readable files of a layout; files with a parse error yield nothing."""
    return table.join(sound_files(files).filter(F.col("layout") == layout).select("file_id"), "file_id", "left_semi")


def sound_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("parse_error").isNull()) if "parse_error" in files.columns else files


def store_cells(spark: SparkSession, parts: dict[str, DataFrame], buckets: int | None = None) -> DataFrame:
    """Write the filled cells of each layout once and return them as stored.

    The table is partitioned by layout and bucketed by (file, sheet): a layout reads its own
    folder only, and what it gathers per sheet, or per row of a sheet, needs no shuffle. It
    lies in the shared folder. By default there are as many buckets as shuffle partitions.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    name = f"filled_cells_{uuid.uuid4().hex}"
    layouts = [part.select(*CELL, "num", "text", F.lit(layout).alias("layout")) for layout, part in parts.items()]
    # Each task writes one bucket, so that a bucket is one file per layout.
    rows = reduce(DataFrame.unionByName, layouts).repartition(n, *SHEET)
    writer = rows.write.partitionBy("layout").bucketBy(n, *SHEET).sortBy(*SHEET)
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


@dataclass(frozen=True)
class Extraction:
    """What a layout yields; labour has (trade, headcount), machines have (name, qty)."""

    days: DataFrame
    items: DataFrame
    labour: DataFrame
    machines: DataFrame


def _no_extras(days: DataFrame, *fields: str) -> DataFrame:
    columns = [F.lit(None).cast("string").alias(fields[0]), F.lit(None).cast("double").alias(fields[1])]
    return days.filter(F.lit(False)).select(*DAY_KEY, F.lit(0).alias("pos"), *columns)


def read_text_log(inputs: FileInputs) -> Extraction:
    days = text_log.text_log_days(inputs.pages)
    empty = _no_extras(days, "trade", "headcount"), _no_extras(days, "name", "qty")
    return Extraction(days, text_log.text_rows(inputs.pages), *empty)


def read_form_sheets(inputs: FileInputs) -> Extraction:
    extras = form_sheet.form_extras(inputs.form_cells(form_sheet.EXTRA_AREA))
    labour = extras.filter(F.col("trade").isNotNull()).select(*DAY_KEY, F.col("row").alias("pos"), "trade", "headcount")
    machines = extras.filter(F.col("machine").isNotNull()).select(
        *DAY_KEY, F.col("row").alias("pos"), F.col("machine").alias("name"), F.col("machine_qty").alias("qty")
    )
    days = form_sheet.form_days(inputs.form_cells(form_sheet.HEADER_AREA), inputs.sheets, inputs.form_merges)
    return Extraction(days, form_sheet.form_items(inputs.form_cells(form_sheet.ITEM_AREA)), labour, machines)


def read_matrix(inputs: FileInputs) -> Extraction:
    of_days, of_heads, of_values = (inputs.matrix_cells(a) for a in (matrix_sheet.DAY_AREA, matrix_sheet.HEAD_AREA, matrix_sheet.BODY_AREA))
    days = matrix_sheet.matrix_days(of_days)
    labour = matrix_sheet.matrix_labour(inputs.matrix_cells(matrix_sheet.LABOUR_AREA))
    return Extraction(days, matrix_sheet.matrix_unpivot(of_days, of_heads, of_values), labour, _no_extras(days, "name", "qty"))


# The readers delivered with the system and the layout each one reads.
BUNDLED_LAYOUTS = {
    "金大營造有限公司": "text_log",
    "摯東營造有限公司": "form_sheet",
    "晉林土木包工業": "matrix_sheet",
}

LAYOUTS: dict[str, Callable[[FileInputs], Extraction]] = {
    "text_log": read_text_log,
    "form_sheet": read_form_sheets,
    "matrix_sheet": read_matrix,
}


def with_bundled_layouts(readers: DataFrame) -> DataFrame:
    """Fill the layout column of a catalogue from the delivered readers."""
    pairs = F.create_map(*[F.lit(x) for pair in BUNDLED_LAYOUTS.items() for x in pair])
    return readers.withColumn("layout", F.try_element_at(pairs, F.col("vendor_key")))


def file_layouts(files: DataFrame, project_vendors: DataFrame, readers: DataFrame) -> DataFrame:
    """Files with vendor name, reader key and layout; each is null where the chain breaks.

    ``files``: file_id, project_id, …; ``project_vendors``: id, vendor_name; ``readers``
    is a catalogue with a layout column.
    """
    vendors = project_vendors.select(F.col("id").alias("project_id"), "vendor_name")
    usable = installed_readers(readers).select("vendor_key", "layout")
    named = files.join(vendors, "project_id", "left")
    return named.join(usable, named["vendor_name"] == usable["vendor_key"], "left")


def extract_all(
    files: DataFrame,
    inputs: FileInputs,
    layouts: dict[str, Callable[[FileInputs], Extraction]] | None = None,
) -> Extraction:
    """Run each layout over all of its files at once and union the results.

    ``files`` comes from :func:`file_layouts`. Files with a parse error are left to the
    report outcome and yield no days.
    """
    sound = sound_files(files)
    parts = [
        layout(inputs.of(sound, name))
        for name, layout in (LAYOUTS if layouts is None else layouts).items()
    ]

    def union(pick: Callable[[Extraction], DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, map(pick, parts))

    return Extraction(
        union(lambda p: p.days.select(*DAY_KEY, *DAY_FIELDS)),
        union(lambda p: p.items.select(*DAY_KEY, F.col("item_pos").cast("bigint").alias("item_pos"), *ITEM_FIELDS)),
        union(lambda p: p.labour.select(*DAY_KEY, F.col("pos").cast("bigint").alias("pos"), "trade", "headcount")),
        union(lambda p: p.machines.select(*DAY_KEY, F.col("pos").cast("bigint").alias("pos"), "name", "qty")),
    )


def nest_days(found: Extraction) -> DataFrame:
    """Each day with its rows, labour and machines as ordered arrays; see :func:`nest_kinds` for pages."""
    kinds = {
        "rows": (found.items, "item_pos", ITEM_FIELDS),
        "labour": (found.labour, "pos", ["trade", "headcount"]),
        "machines": (found.machines, "pos", ["name", "qty"]),
    }
    return nest_kinds(found.days, DAY_KEY, DAY_FIELDS, kinds)


def first_days(days: DataFrame) -> DataFrame:
    """Only the first day of each file, found by an aggregate instead of a window."""
    first = days.groupBy("file_id").agg(F.min("day_pos").alias("day_pos"))
    return days.join(first, DAY_KEY, "left_semi")


def with_log_date(days: DataFrame) -> DataFrame:
    """Add the typed date; impossible dates stay as text and get a null date."""
    return days.withColumn("log_date", F.col("log_date_raw").try_cast("date"))
