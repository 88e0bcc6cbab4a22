"""Status grid, search, children, imports, changes and checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteledger.operators import changes, masters, quality
from siteledger.plans import status
from siteledger.schemas import TABLES, create_missing_tables, read_table
from siteledger.sources import lists

D = dt.date


def projects(spark, *rows):
    """rows: (id, start, created)"""
    return spark.createDataFrame(list(rows), "id bigint, start_date date, created_at timestamp")


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), "project_id bigint, period string, type string")


def settings(spark, day=None):
    return spark.createDataFrame([("settlement_day", day)] if day else [], "key string, value string")


def run(spark, project_rows, ledger_rows, now, day=None):
    grid = status.submission_status(projects(spark, *project_rows), ledger(spark, *ledger_rows), settings(spark, day), now)
    return [(r.project_id, r.period, r.deadline, r.status) for r in grid.orderBy("project_id", "period").collect()]


def test_three_months(spark):
    got = run(spark, [(1, D(2026, 5, 20), None)], [(1, "2026-06", "monthly")], "2026-07-02T10:00:00+08:00")
    assert got == [
        (1, "2026-05", "2026-05-05", "overdue"),
        (1, "2026-06", "2026-06-05", "submitted"),
        (1, "2026-07", "2026-07-05", "pending"),
    ]


@pytest.mark.parametrize(
    ("now", "state"),
    [
        ("2026-07-05T00:00:00+08:00", "overdue"),
        ("2026-07-04T23:59:59+08:00", "pending"),
        ("2026-07-04T16:00:00+00:00", "overdue"),
        ("2026-07-04T15:59:59+00:00", "pending"),
    ],
)
def test_boundary_is_midnight_in_taipei(spark, now, state):
    assert [r[3] for r in run(spark, [(1, D(2026, 7, 1), None)], [], now)] == [state]


def test_supervision_and_odd_periods_do_not_count(spark):
    odd = [(1, "2026-07", "supervision"), (1, None, "monthly"), (1, "2026-7", "monthly"), (1, "2026-13", "monthly")]
    assert [r[3] for r in run(spark, [(1, D(2026, 7, 1), None)], odd, "2026-07-20T00:00:00+08:00")] == ["overdue"]


def test_repeated_ledger_rows_and_other_projects(spark):
    rows = [(1, "2026-07", "monthly")] * 50 + [(2, "2026-06", "monthly")]
    got = run(spark, [(1, D(2026, 7, 1), None), (2, D(2026, 7, 1), None)], rows, "2026-07-20T00:00:00+08:00", "10")
    assert got == [(1, "2026-07", "2026-07-10", "submitted"), (2, "2026-07", "2026-07-10", "overdue")]


def test_start_falls_back_to_creation_then_now(spark):
    rows = [(1, None, dt.datetime(2026, 6, 9)), (2, None, None), (3, D(2026, 8, 1), None)]
    got = run(spark, rows, [], "2026-07-02T00:00:00+08:00")
    assert [r[:2] for r in got] == [(1, "2026-06"), (1, "2026-07"), (2, "2026-07")]


def test_spine_holds_every_month_of_a_long_project(spark):
    spine = status.period_spine(projects(spark, (1, D(1880, 1, 1), None)), "2026-07-02T00:00:00+08:00")
    assert (spine.count(), spine.agg(F.max("period")).collect()[0][0]) == (146 * 12 + 7, "2026-07")


def test_status_needs_one_shuffle_and_no_join(spark):
    grid = status.submission_status(
        projects(spark, (1, D(2026, 5, 1), None)), ledger(spark, (1, "2026-05", "monthly")), settings(spark), "2026-07-02T00:00:00+08:00"
    )
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_search(spark):
    df = spark.createDataFrame([(1, "Beta"), (2, "alpha"), (3, "甲廠")], "id bigint, name string")
    assert [r.name for r in masters.search_by_name(df, None, ["name"]).collect()] == ["Beta", "alpha", "甲廠"]
    assert [r.name for r in masters.search_by_name(df, " A ", ["name"]).collect()] == ["Beta", "alpha"]
    assert [r.name for r in masters.search_by_name(df, "　", ["name"]).collect()] == ["Beta", "alpha", "甲廠"]
    assert [r.name for r in masters.search_by_name(df, "b%a", ["name"]).collect()] == ["Beta"]


def test_project_search_and_fee_text(spark):
    df = spark.createDataFrame(
        [
            (1, "P-1", "橋", "lump_sum", 500000.0, None, None),
            (2, None, "路", "pct", None, 1234567.0, 2.5),
            (3, "橋-3", "x", "pct", None, None, 2.5),
            (4, "P-4", "y", None, None, None, None),
        ],
        "id bigint, project_no string, name string, design_fee_type string, design_fee_amount double, award_amount double, design_fee_pct double",
    )
    assert [r.id for r in masters.search_projects(df, "橋").collect()] == [3, 1]
    assert [r.id for r in masters.search_projects(df, "").collect()] == [4, 3, 2, 1]
    shown = {r.id: r.fee_text for r in masters.fee_display(df).collect()}
    assert shown == {1: "500,000 元", 2: "30,864 元", 3: "未招標,待補", 4: "—"}


def test_normalize_turns_empty_text_into_null(spark):
    df = spark.createDataFrame([(1, "", "n", "")], "id bigint, project_no string, name string, start_date string")
    row = masters.normalized_projects(df).collect()[0]
    assert (row.id, row.project_no, row.name, row.start_date) == (1, None, "n", None)


def test_only_the_first_flag_stays(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, None), (3, 5, True)]
    df = spark.createDataFrame(rows, "parent int, pos int, is_primary boolean")
    got = {(r.parent, r.pos): r.is_primary for r in masters.single_primary(df, "parent", "pos").collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 3): False, (2, 1): False, (3, 5): True}


def test_children_cleaning(spark):
    df = spark.createDataFrame([(1, "a", "", None), (2, "　", "x", True)], "id int, name string, phone string, is_primary boolean")
    assert [(r.id, r.phone, r.is_primary) for r in masters.clean_contacts(df).orderBy("id").collect()] == [(1, None, False), (2, "x", True)]
    assert [r.id for r in masters.named_children(df).collect()] == [1]


def test_import(spark):
    texts = spark.createDataFrame([(1, "甲廠\r\n\n乙廠\n甲廠　\n  \n已存在\n丙廠")], "k int, t string")
    lines = lists.import_lines(texts, "k", "t")
    known = spark.createDataFrame([("已存在",), ("已存在",)], "name string")
    fresh = masters.import_names(lines, ["k", "line_no"], known).orderBy("line_no").collect()
    assert [(r.name, r.line_no) for r in fresh] == [("甲廠", 0), ("乙廠", 2), ("丙廠", 6)]
    totals = masters.import_totals(lines, known).collect()[0]
    assert (totals.created, totals.skipped) == (3, 2)
    empty = masters.import_totals(lines.filter("false"), known).collect()[0]
    assert (empty.created, empty.skipped) == (0, 0)


def test_updates_and_deletes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    log = spark.createDataFrame(
        [(1, "update", 1, "old"), (3, "update", 1, None), (2, "update", 9, "nobody"), (4, "update", 3, "x"), (5, "delete", 3, None)],
        "seq int, op string, id int, name string",
    )
    assert sorted(map(tuple, changes.merge_changes(base, log, "id", "seq").collect())) == [(1, "old"), (2, "b")]
    assert [r.id for r in changes.unknown_updates(base, log.filter("op = 'update'"), "id").collect()] == [9]


def test_replace_children(spark):
    schema = "id int, parent int, name string, is_primary boolean"
    old = spark.createDataFrame([(1, 1, "a", True), (2, 2, "b", True)], schema)
    fresh = spark.createDataFrame([(3, 1, "c", True), (4, 1, "d", True)], schema)
    got = changes.replace_children(old, fresh, fresh, "parent", "id")
    assert sorted((r.id, r.is_primary) for r in got.collect()) == [(2, True), (3, True), (4, False)]


def test_intake_rejects_blank_names(spark):
    df = spark.createDataFrame([(1, " 甲 "), (2, "　"), (3, None)], "id int, name string")
    got = {r.id: (r.name, r.accepted, r.error) for r in changes.intake_named(df, "vendors").collect()}
    assert got == {1: ("甲", True, None), 2: ("", False, "廠商名稱為必填"), 3: ("", False, "廠商名稱為必填")}


def test_deletion_plan_leaves_unsafe_paths(spark):
    rows = [(1, "a/b.pdf", "", "../x"), (2, "c.pdf", None, None)]
    df = spark.createDataFrame(rows, "id int, daily_log_path string, official_doc_path string, report_path string")
    plan = changes.deletion_plan(df, df.filter("id = 1").select("id"))
    assert [tuple(r) for r in plan.collect()] == [(1, "daily_log_path", "a/b.pdf")]


def test_backfill(spark):
    df = spark.createDataFrame([(1, "old"), (2, None)], "id int, report_path string")
    new = spark.createDataFrame([(2, "new")], "id int, report_path string")
    assert sorted(map(tuple, changes.backfill_reports(df, new).collect())) == [(1, "old"), (2, "new")]


def test_settings_keep_the_last_valid_change(spark):
    rows = [(1, "settlement_day", "10"), (2, "settlement_day", "29"), (3, "settlement_day", "7x"), (4, "settlement_day", "0")]
    got = lists.latest_settings(spark.createDataFrame(rows, "seq int, key string, value string")).collect()
    assert [tuple(r) for r in got] == [("settlement_day", "7")]


def test_tables_are_created_once(spark, tmp_path):
    root = str(tmp_path)
    assert sorted(create_missing_tables(spark, root)) == sorted(TABLES)
    changes.append_rows(spark.createDataFrame([(1, "v", None)], TABLES["vendors"]), f"{root}/vendors")
    assert create_missing_tables(spark, root) == []
    assert read_table(spark, root, "vendors").count() == 1
    assert "password_hash" not in read_table(spark, root, "users").columns


def test_wide_view_takes_only_the_insurers_own_type(spark):
    p = spark.createDataFrame([(1, 1, None, 1, 7), (2, None, 1, 2, 7)], "id int, vendor_id int, school_id int, insurer_id int, insurance_type_id int")

    def named(*rows):
        return spark.createDataFrame(list(rows), "id int, name string")

    types = spark.createDataFrame([(7, 1, "t")], "id int, insurer_id int, name string")
    wide = masters.project_wide(p, named((1, "v")), named((1, "s")), named((1, "i"), (2, "j")), types)
    got = {r.id: (r.vendor_name, r.school_name, r.insurer_name, r.insurance_type_name) for r in wide.collect()}
    assert got == {1: ("v", None, "i", "t"), 2: (None, "s", "j", None)}


def test_checks(spark):
    vendors = spark.createDataFrame([(1, "a"), (2, " ")], "id bigint, name string")
    contacts = spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None)], "id bigint, vendor_id bigint")
    users = spark.createDataFrame([("u",), ("u",), ("w",)], "username string")
    fk = quality.fk_violations({"vendors": vendors, "vendor_contacts": contacts}).collect()
    assert [tuple(r) for r in fk] == [("vendor_contacts", "vendor_id", 9, 2)]
    keys = quality.key_violations({"vendors": vendors, "users": users}).collect()
    assert sorted(map(tuple, keys)) == [("users", "username", "repeated", "u", 2), ("vendors", "name", "blank", " ", 1)]


def test_log_checks(spark):
    items = spark.createDataFrame([(1, 1, 5.0, 2.0, 10.0), (1, 2, 5.0, 2.0, 11.0), (1, 3, 5.0, None, 9.0)], "file_id int, day_pos int, unit_price double, today_qty double, today_amount double")
    assert [(r.day_pos, r.expected_amount) for r in quality.amount_mismatch(items).collect()] == [(2, 10.0)]
    totals = spark.createDataFrame(
        [(1, 1, 5.0, 1.0), (1, 2, 4.0, 3.0), (1, 3, 4.0, 2.0), (1, 4, 3.0, 1.0), (1, 5, None, 5.0), (1, 6, 1.0, None), (2, 1, 9.0, 9.0)],
        "file_id int, day_pos int, cum_qty double, cum_amount double",
    )
    fell = quality.falling_totals(totals, ["file_id"], ["cum_qty", "cum_amount"], 2).collect()
    assert sorted((r.file_id, r.day_pos, r.falling) for r in fell) == [(1, 2, ["cum_qty"]), (1, 3, ["cum_amount"]), (1, 4, ["cum_qty", "cum_amount"])]
    days = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (2, 2, "b")], "file_id int, day_pos int, project_name string")
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 2)], "file_id int, day_pos int")
    assert {r.file_id: r.consistent for r in quality.file_consistency(days, rows).collect()} == {1: True, 2: False}


def test_admin_flag(spark):
    users = spark.createDataFrame([(1, "admin"), (2, "user")], "id int, role string")
    asked = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "request_id int, user_id int")
    got = {r.request_id: r.authorized for r in masters.authorized_requests(asked, users).collect()}
    assert got == {10: True, 11: False, 12: False}


def test_labels(spark):
    grid = spark.createDataFrame([("submitted",), ("overdue",), ("pending",), ("?",)], "status string")
    assert [r.status_label for r in masters.status_display(grid).collect()] == ["已繳", "未繳", "未到期", ""]


def test_search_takes_a_backslash_as_it_is(spark):
    df = spark.createDataFrame([(1, "a\\b"), (2, "ab"), (3, "a\\%")], "id bigint, name string")
    assert [r.id for r in masters.search_by_name(df, "\\", ["id", "name"]).collect()] == [3, 1]
    assert [r.id for r in masters.search_by_name(df, "a\\b", ["id", "name"]).collect()] == [1]


def test_changes_that_are_refused(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    log = spark.createDataFrame([(1, "new", 1), (1, " ", 2), (2, None, 3)], "id bigint, name string, seq int")
    assert sorted(map(tuple, changes.apply_updates(base, log, "id", "seq").collect())) == [(1, "new"), (2, "b")]
    assert sorted((r.id, r.error) for r in changes.refused_updates(log, "vendors").collect()) == [(1, "廠商名稱為必填"), (2, "廠商名稱為必填")]
    uses = spark.createDataFrame([(1,), (None,)], "vendor_id bigint")
    assert [r.id for r in changes.refused_deletes(base, [(uses, "vendor_id")]).collect()] == [1]
    assert [r.id for r in changes.delete_unreferenced(base, base, [(uses, "vendor_id")]).collect()] == [1]


def test_absent_project_fields_become_null(spark):
    row = masters.normalized_projects(spark.createDataFrame([(1, "")], "id bigint, name string")).collect()[0]
    assert set(masters.PROJECT_FIELDS) <= set(row.asDict()) and row.name is None and row.award_amount is None
