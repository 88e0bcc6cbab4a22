"""Files are gathered once; what is grouped by file later needs no shuffle, and crowded files go another way."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from siteledger.operators import cells as cell_ops
from siteledger.operators.ranking import spread_of
from siteledger.plans import form_sheet, matrix_sheet
from siteledger.sources.star_views import StarViews

SF = "/root/testdata/sf0.001"


def exchanges(df, name="Exchange hashpartitioning"):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def lines_of(tmp_path, spark):
    """Tables where file 1 holds most lines, many of them copies."""
    base = spark.read.parquet(f"{SF}/lineitem.parquet").limit(40)
    many = base.crossJoin(spark.range(30).withColumnRenamed("id", "__i")).withColumns(
        {"l_orderkey": F.lit(1).cast("bigint"), "l_shipdate": F.lit("1995-03-04").cast(dict(base.dtypes)["l_shipdate"])}
    )
    base.unionByName(many.drop("__i")).write.parquet(f"{tmp_path}/lineitem.parquet")
    os.symlink(f"{SF}/part.parquet", f"{tmp_path}/part.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("table", ["work", "work_items", "day_totals", "matrix_cells", "form_cells", "pages"])
def test_crowded_files_give_the_same_rows(spark, tmp_path, table):
    folder = lines_of(tmp_path, spark)
    plain, apart = StarViews(spark, folder), StarViews(spark, folder)
    lines = apart.table("lineitem").select(F.col("l_orderkey").alias("file_id"))
    apart.by_file = spread_of(lines, "file_id", crowded_rows=100)
    assert len(apart.by_file.crowded) == 1 and not plain.by_file.crowded
    columns = sorted(getattr(plain, table).columns)
    assert rows(getattr(plain, table).select(columns)) == rows(getattr(apart, table).select(columns))


def test_cells_of_gathered_files_are_not_shuffled(spark):
    v = StarViews(spark, SF)
    # the lines of work_items and of day_totals, one row per part
    assert exchanges(form_sheet.form_items(cell_ops.clean_cells(v.form_cells))) <= 3
    assert exchanges(form_sheet.form_extras(cell_ops.clean_cells(v.form_cells))) <= 3
    days = matrix_sheet.real_days(cell_ops.clean_cells(v.matrix_cells))
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "day_" in line]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matrix_outputs_join_nothing_by_day(spark):
    cells = cell_ops.clean_cells(StarViews(spark, SF).matrix_cells)
    assert "Join" not in plan_of(matrix_sheet.matrix_labour(cells))
    shuffled = [line for line in plan_of(matrix_sheet.matrix_unpivot(cells)).splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in shuffled if "day_row" in line]


@pytest.mark.parametrize("area, read", [("DAY_AREA", matrix_sheet.matrix_days), ("DAY_AREA", matrix_sheet.real_days), ("LABOUR_AREA", matrix_sheet.matrix_labour)])
def test_matrix_cells_of_an_area_give_the_same_rows(spark, tmp_path, area, read):
    v = StarViews(spark, lines_of(tmp_path, spark))
    v.by_file = spread_of(v.table("lineitem").select(F.col("l_orderkey").alias("file_id")), "file_id", crowded_rows=100)
    wanted = getattr(matrix_sheet, area)
    cells = cell_ops.clean_cells(v.matrix_cells_in(wanted))
    assert rows(read(cells)) == rows(read(cell_ops.clean_cells(v.matrix_cells)))
    assert cells.filter("sheet = 'so'").filter(~F.col("col").isin(list(wanted.columns)) | (F.col("row") < 7)).isEmpty()


def test_matrix_days_gather_no_items(spark):
    from siteledger.queries import layouts

    gathered = [line for line in plan_of(layouts.matrix_days(StarViews(spark, SF))).splitlines() if "Exchange hashpartitioning" in line]
    # items whose columns are read (none), days, files
    assert len(gathered) == 3


def test_disjoint_ranges_and_headers_shuffle_no_cells(spark):
    v = StarViews(spark, SF)
    clean = cell_ops.clean_cells(v.form_cells)
    filled = cell_ops.merge_fill(clean, v.form_sheets, v.form_merges, overlapping=False)
    shuffled = [line for line in plan_of(filled).splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in shuffled if "row#" in line and "col#" in line]


def test_extraction_stores_no_cells(spark, monkeypatch):
    from siteledger.plans import dispatch
    from siteledger.queries import layouts

    def refuse(*_):
        raise AssertionError("cells are stored")

    monkeypatch.setattr(dispatch, "store_cells", refuse)
    assert layouts._extraction(StarViews(spark, SF)).labour.columns == ["file_id", "day_pos", "pos", "trade", "headcount"]


def test_lines_of_some_files_stay_spread_over_tasks(spark):
    v = StarViews(spark, SF)
    some = v.of_files(v.table("orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file_id")))
    plan = plan_of(some.work)
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line or "Exchange hashpartitioning(file_id" in line]
    assert shuffled and all("REPARTITION_BY_NUM" in line for line in shuffled)
    assert rows(some.work) == rows(v.work.filter("file_id % 3 = 0"))


@pytest.mark.parametrize("area, read", [("HEADER_AREA", form_sheet.form_days), ("ITEM_AREA", form_sheet.form_items), ("EXTRA_AREA", form_sheet.form_extras)])
def test_cells_of_an_area_give_the_same_rows(spark, area, read):
    v, wanted = StarViews(spark, SF), getattr(form_sheet, area)
    sheets = [v.form_sheets] if read is form_sheet.form_days else []
    cells = cell_ops.clean_cells(v.form_cells_in(wanted))
    assert rows(read(cells, *sheets)) == rows(read(cell_ops.clean_cells(v.form_cells), *sheets))
    assert cells.filter(~F.col("col").isin(list(wanted.columns))).isEmpty()


def test_extras_make_no_item_cells(spark):
    from siteledger.queries import layouts

    v = StarViews(spark, SF)
    assert "p_name" not in plan_of(layouts.sheet_extras(v))
    assert "p_name" not in plan_of(layouts.all_machines(v))


def test_days_gathered_by_file_meet_their_submissions_unshuffled(spark):
    from siteledger.queries import reports

    v = StarViews(spark, SF)
    shuffled = [line for line in plan_of(reports.report_sheets(v)).splitlines() if "Exchange hashpartitioning" in line]
    # lines for the days, lines and orders for the submissions, submissions by file; no month, bucket or submission
    assert not [line for line in shuffled if "day_pos" in line or "__bucket" in line or "submission_id" in line or "month" in line]


def test_crowded_files_get_the_same_sheets(spark, tmp_path):
    from siteledger.plans import report

    v = StarViews(spark, lines_of(tmp_path, spark))
    days = v.days.select("file_id", "day_pos", "log_date_raw")
    subs = spark.createDataFrame(
        [("a", 1, "1995-03", "monthly", 1), ("b", 1, "x", "supervision", 1), ("c", 1, "1990-01", "monthly", 1), ("d", 2, "1990-01", "supervision", -3), ("e", 2, None, None, 1)],
        "submission_id string, project_id bigint, period string, type string, file_id bigint",
    )
    subs = subs.unionByName(v.days.select(F.concat(F.lit("f"), "file_id").alias("submission_id"), F.col("file_id").alias("project_id"), F.lit("x").alias("period"), F.lit("supervision").alias("type"), "file_id").distinct())
    lines = v.table("lineitem").select(F.col("l_orderkey").alias("file_id"))
    spread = spread_of(lines, "file_id", crowded_rows=100)
    assert len(spread.crowded) == 1

    def sheets(known):
        return rows(report.report_sheets(subs, days, 64, known).select("submission_id", "file_id", "day_pos", "sheet_name"))

    assert sheets(spread) == sheets(None) == sheets(spread_of(lines, "file_id"))
    columns = ["submission_id", "day_pos", "log_date_raw"]
    assert rows(report.report_days(subs, days, spread).select(columns)) == rows(report.report_days(subs, days).select(columns))


def test_form_headers_gather_day_counts_and_join_nothing(spark):
    """Neither lines with their columns nor cells are shuffled, only the files and days of the lines."""
    from siteledger.queries import layouts

    plan = plan_of(layouts.form_sheet_days(StarViews(spark, SF)))
    assert "Join" not in plan and "l_partkey" not in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not [line for line in shuffled if "sheet" in line]


def test_day_counts_are_those_of_placed_lines(spark, tmp_path):
    v = StarViews(spark, lines_of(tmp_path, spark))
    columns = ["file_id", "day_no", "day_pos", "log_date_raw", "n_items"]
    assert rows(v.day_counts.select(columns)) == rows(v.day_totals.select(columns))
    v.by_file = spread_of(v.table("lineitem").select(F.col("l_orderkey").alias("file_id")), "file_id", crowded_rows=100)
    apart = StarViews(spark, str(tmp_path))
    apart.by_file = v.by_file
    assert len(v.by_file.crowded) == 1 and rows(apart.day_counts.select(columns)) == rows(v.day_totals.select(columns))


def test_headers_fill_ranges_as_merge_fill_does(spark):
    """Origins, edges, empty starts, sheets without cells or without a listing."""
    from siteledger.schemas import schema_of

    def cells_on(file_id, sheet, values):
        return [(file_id, sheet, r, c, float(v) if isinstance(v, int) else None, str(v)) for (r, c), v in values.items()]

    filled = {(0, 0): "a", (1, 2): 45950, (2, 0): "p", (6, 3): 7, (6, 16): "own", (30, 30): "far"}
    names = [(1, "(1)"), (1, "(2)"), (1, "(3)"), (2, "(1)"), (2, "(4)"), (3, "x")]
    cells = spark.createDataFrame([x for f, n in names[:4] + [(9, "(1)")] for x in cells_on(f, n, filled)], "file_id bigint, sheet string, row int, col int, num double, text string")
    sizes = {(1, "(2)"): (1, 2, 100, 250), (1, "(3)"): (0, 0, 6, 10)}
    sheets = spark.createDataFrame([(f, n, i, *sizes.get((f, n), (0, 0, 100, 250))) for i, (f, n) in enumerate(names)], schema_of("sheets"))
    ranges = [(0, 0, 1, 1), (1, 2, 1, 40), (2, 0, 3, 2), (6, 3, 6, 17), (4, 0, 5, 200)]
    merges = [(f, n, i, *x) for f, n in [(1, "(1)"), (2, "(1)"), (2, "(4)"), (9, "(1)")] for i, x in enumerate(ranges)]
    merges += [(1, "(2)", i, a + 1, b + 2, c + 1, d + 2) for i, (a, b, c, d) in enumerate([*ranges, (-1, 0, -1, 90)])]
    merges += [(1, "(3)", i, *x) for i, x in enumerate(ranges)]
    merged = spark.createDataFrame(merges, schema_of("merges"))
    plain = form_sheet.form_days(cell_ops.merge_fill(cells, sheets, merged, overlapping=False), sheets)
    found = form_sheet.form_days(cells, sheets, merged)
    assert rows(found) == rows(plain) and found.count() == 5
    assert {(r.file_id, r.day_pos): (r.project_name, r.planned_pct) for r in found.collect()}[(1, 1)] == ("p", 7)


def test_outputs_of_a_layout_begin_with_its_own_lines(spark):
    """The files are worked out once; no output reads orders, joins lines with files or reads the lines of other layouts."""
    from siteledger.plans import dispatch
    from siteledger.queries import layouts

    v = StarViews(spark, SF)
    found = layouts._extraction(v)
    for table in (found.days, found.items, found.labour, found.machines):
        plan = plan_of(table)
        assert "o_orderkey" not in plan and "LeftSemi" not in plan
        scans = [line for line in plan.splitlines() if "FileScan" in line and "l_orderkey" in line]
        assert scans and all("layout#" in line.split("PartitionFilters")[1] for line in scans)
    assert found.days.count() == dispatch.nest_days(found).filter("page = 0").count()


def test_matrix_items_of_their_areas_are_those_of_all_cells(spark, tmp_path):
    v = StarViews(spark, lines_of(tmp_path, spark))
    parts = [cell_ops.clean_cells(v.matrix_cells_in(a)) for a in (matrix_sheet.DAY_AREA, matrix_sheet.HEAD_AREA, matrix_sheet.BODY_AREA)]
    assert rows(matrix_sheet.matrix_unpivot(*parts)) == rows(matrix_sheet.matrix_unpivot(cell_ops.clean_cells(v.matrix_cells)))


@pytest.mark.parametrize("name", ["form_sheet_days", "matrix_days"])
def test_generated_methods_are_short_enough_to_be_compiled(spark, name):
    import re

    from siteledger.queries import layouts

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = getattr(layouts, name)(StarViews(spark, SF))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) < 8000
