"""Cell cleaning, merged ranges and fixed addresses."""

import random

from pyspark.sql import functions as F

from siteledger.operators.cells import clean_cells, merge_fill, one_sheet, sheet_values
from siteledger.schemas import schema_of


def cells(spark, rows, sheet="s", file_id=1):
    """rows: (row, col, type, value)"""
    data = []
    for r, c, kind, value in rows:
        num = float(value) if kind in "neb" else None
        data.append((file_id, sheet, 0, r, c, kind, num, value if kind == "s" else None))
    return spark.createDataFrame(data, schema_of("cells"))


def sheets(spark, rows=10, cols=10, origin=(0, 0), sheet="s", file_id=1):
    return spark.createDataFrame([(file_id, sheet, 0, *origin, rows, cols)], schema_of("sheets"))


def merges(spark, ranges, sheet="s", file_id=1):
    return spark.createDataFrame([(file_id, sheet, i, *m) for i, m in enumerate(ranges)], schema_of("merges"))


def grid(df):
    return {(r.row, r.col): r.num if r.num is not None else r.text for r in df.collect()}


def test_error_cells_become_empty(spark):
    df = clean_cells(cells(spark, [(0, 0, "n", 35), (0, 1, "e", 23), (0, 2, "e", 15), (0, 3, "s", "x")]))
    assert grid(df) == {(0, 0): 35, (0, 3): "x"}
    assert {r.text for r in df.collect()} == {"35", "x"}


def test_booleans_are_no_numbers(spark):
    df = clean_cells(cells(spark, [(0, 0, "b", 1), (0, 1, "b", 0), (0, 2, "n", 1)]))
    assert {r.col: (r.num, r.text) for r in df.collect()} == {0: (None, "true"), 1: (None, "false"), 2: (1.0, "1")}


def test_origin_is_subtracted(spark):
    df = clean_cells(cells(spark, [(5, 3, "n", 1)]), sheets(spark, origin=(4, 2)))
    assert grid(df) == {(1, 1): 1}


def test_one_sheet(spark):
    assert one_sheet(cells(spark, [(0, 0, "n", 1)], sheet="other"), "s").count() == 0


def test_merge_fill_copies_the_start(spark):
    df = clean_cells(cells(spark, [(0, 0, "n", 599)]))
    assert grid(merge_fill(df, sheets(spark), merges(spark, [(0, 0, 0, 2)]))) == {(0, 0): 599, (0, 1): 599, (0, 2): 599}


def test_merge_fill_keeps_values_and_clips(spark):
    df = clean_cells(cells(spark, [(0, 0, "s", "a"), (0, 1, "s", "b")]))
    filled = merge_fill(df, sheets(spark, rows=2, cols=3), merges(spark, [(0, 0, 9, 9)]))
    assert grid(filled) == {(0, 0): "a", (0, 1): "b", (0, 2): "a", (1, 0): "a", (1, 1): "a", (1, 2): "a"}


def test_merge_fill_ignores_empty_starts_and_outside_starts(spark):
    df = clean_cells(cells(spark, [(5, 5, "n", 1)]))
    filled = merge_fill(df, sheets(spark), merges(spark, [(0, 0, 1, 1), (20, 20, 30, 30)]))
    assert grid(filled) == {(5, 5): 1}


def test_disjoint_shortcut_agrees(spark):
    df = clean_cells(cells(spark, [(0, 0, "n", 1), (3, 3, "s", "x")]))
    ranges = merges(spark, [(0, 0, 1, 1), (3, 3, 3, 5), (7, 7, 8, 8)])
    assert grid(merge_fill(df, sheets(spark), ranges)) == grid(merge_fill(df, sheets(spark), ranges, overlapping=False))


def test_only_wanted_columns_are_filled(spark):
    df = clean_cells(cells(spark, [(0, 0, "n", 1), (0, 3, "n", 2), (1, 1, "s", "x")]))
    filled = merge_fill(df, sheets(spark), merges(spark, [(0, 0, 1, 2)]), columns=[1, 3])
    assert grid(filled) == {(0, 1): 1, (0, 3): 2, (1, 1): "x"}


def fill_loop(values, ranges, n_rows, n_cols):
    """The same rule as a loop over one sheet."""
    out = dict(values)
    for r0, c0, r1, c1 in ranges:
        start = out.get((r0, c0))
        if r0 >= n_rows or c0 >= n_cols or start is None:
            continue
        for r in range(r0, min(r1, n_rows - 1) + 1):
            for c in range(c0, min(c1, n_cols - 1) + 1):
                out.setdefault((r, c), start)
    return out


def test_overlapping_ranges_match_the_loop(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        values = {(rng.randrange(12), rng.randrange(12)): i for i in range(15)}
        ranges = []
        for _ in range(30):
            r, c = rng.randrange(13), rng.randrange(13)
            ranges.append((r, c, r + rng.randrange(4), c + rng.randrange(4)))
        df = clean_cells(cells(spark, [(r, c, "n", v) for (r, c), v in values.items()]))
        filled = merge_fill(df, sheets(spark, 12, 12), merges(spark, ranges))
        assert grid(filled) == fill_loop(values, ranges, 12, 12)


def test_chained_start_waits_for_an_earlier_open_range(spark):
    # Range 1 gets its value from range 0; range 3 must take range 1's value, not range 2's.
    df = clean_cells(cells(spark, [(0, 0, "s", "first"), (5, 0, "s", "second")]))
    ranges = [(0, 0, 0, 2), (0, 2, 6, 2), (5, 0, 5, 4), (5, 2, 8, 5)]
    want = fill_loop({(0, 0): "first", (5, 0): "second"}, ranges, 10, 10)
    assert grid(merge_fill(df, sheets(spark), merges(spark, ranges))) == want
    assert want[8, 5] == "first"


def test_chain_of_ten_ranges(spark):
    """Each range starts in the last cell of the one before; given out of order as well."""
    ranges = [(n, n, n + 1, n + 1) for n in range(10)]
    df = clean_cells(cells(spark, [(0, 0, "s", "x"), (4, 5, "s", "y")]))
    filled = merge_fill(df, sheets(spark, 20, 20), merges(spark, ranges).orderBy("r0", ascending=False))
    assert grid(filled) == fill_loop({(0, 0): "x", (4, 5): "y"}, ranges, 20, 20)
    reverse = ranges[::-1]
    assert grid(merge_fill(df, sheets(spark, 20, 20), merges(spark, reverse))) == fill_loop({(0, 0): "x", (4, 5): "y"}, reverse, 20, 20)


def test_filling_is_one_plan_with_four_shuffles(spark, tmp_path):
    """No job runs while the plan is built, and stored cells are shuffled once for both joins."""
    rng = random.Random(7)
    values = [(rng.randrange(40), rng.randrange(12), "n", i) for i in range(200)]
    clean_cells(cells(spark, values)).write.parquet(str(tmp_path / "c"))
    merges(spark, [(n, 1, n + 1, 3) for n in range(30)]).write.parquet(str(tmp_path / "m"))
    size = sheets(spark, 40, 12)
    size.write.parquet(str(tmp_path / "s"))
    stored = [spark.read.parquet(str(tmp_path / n)) for n in "csm"]
    stored[1] = F.broadcast(stored[1])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("merge-fill", "plan")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = merge_fill(*stored)
        assert not tracker.getJobIdsForGroup("merge-fill")
        filled.collect()
        final = filled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 2**20))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert final.count("+- Exchange hashpartitioning") <= 4 and "ReusedExchange" in final, final


def test_fixed_addresses(spark):
    df = clean_cells(cells(spark, [(1, 4, "s", "晴"), (6, 5, "n", 0.5), (2, 2, "s", "other")]))
    row = sheet_values(df, {"am": (1, "E", "text"), "pct": (6, "F", "num"), "none": (9, "Z", "text")}).collect()[0]
    assert (row.am, row.pct, row.none) == ("晴", 0.5, None)
