"""Reader catalogue, report outcomes, sheets and lines, streaming intake."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteledger.operators import readers
from siteledger.plans import report
from siteledger.sources import lists
from siteledger.streaming import intake as stream

READER = (
    "file_name string, load_seq bigint, load_ok boolean, has_meta boolean, vendor_key string, expected_key string, version string, "
    "target_fields array<string>, target_fields_is_list boolean, has_parse boolean, self_test string, self_test_error string, "
    "op string, installed_at timestamp"
)
GOOD = dict(
    file_name="a.pmisparser.js", load_seq=1, load_ok=True, has_meta=True, vendor_key="甲", expected_key="甲", version="1.0", target_fields=["項次", "單位"],
    target_fields_is_list=True, has_parse=True, self_test="true", self_test_error="boom", op="install", installed_at=dt.datetime(2026, 1, 1),
)


def catalog(spark, *changes):
    rows = [tuple((GOOD | c).values()) for c in changes]
    return spark.createDataFrame(rows, READER)


def reader_of(key, **changes):
    """A sound reader in the file named after its vendor."""
    return {"vendor_key": key, "expected_key": key, "file_name": f"{key}.pmisparser.js"} | changes


def vendors(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, name string")


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({}, None),
        ({"self_test": "none"}, None),
        ({"load_ok": False, "vendor_key": None}, "讀取檔未匯出有效內容"),
        ({"has_meta": False}, "讀取檔缺少 meta"),
        ({"vendor_key": None}, "讀取檔 meta 缺少 vendorKey"),
        ({"vendor_key": "a/b"}, "不是合法廠商名稱"),
        ({"vendor_key": "a/b", "expected_key": "a/b"}, "廠商鍵不合法"),
        ({"vendor_key": "乙"}, "讀取檔廠商鍵(乙)與此廠商(甲)不符"),
        ({"version": ""}, "缺少 version"),
        ({"target_fields_is_list": False}, "須為陣列"),
        ({"has_parse": False, "self_test": "false"}, "缺少 parse function"),
        ({"self_test": "not_function"}, "須為 function"),
        ({"self_test": "error"}, "執行失敗:boom"),
        ({"self_test": "false"}, "未通過"),
    ],
)
def test_rules(spark, change, message):
    row = readers.validate_readers(catalog(spark, change), "expected_key").collect()[0]
    assert row.ok is (message is None)
    assert row.error is None if message is None else message in row.error


def test_catalog_last_file_wins_and_broken_files_are_skipped(spark):
    names = {n: f"{n}.pmisparser.js" for n in "abz"}
    df = catalog(spark, {"file_name": names["b"], "version": None}, {"file_name": names["a"], "version": "9"}, {"file_name": names["z"], "load_ok": False}, {"vendor_key": ""}, {"file_name": "zz.txt"})
    assert [(r.vendor_key, r.file_name, r.version) for r in lists.reader_catalog(df).collect()] == [("甲", names["b"], None)]


def test_log_of_installs(spark):
    df = catalog(
        spark,
        {"load_seq": 1, "version": "1"},
        {"load_seq": 2, "version": "2"},
        {"load_seq": 3, "version": "3", "self_test": "false"},
        reader_of("乙", load_seq=1),
        reader_of("乙", load_seq=2, op="remove", version=None),
        reader_of("丙", load_seq=1, version="1"),
        reader_of("丙", load_seq=2, version="2", vendor_key="甲"),  # made for another vendor: refused
        reader_of("丁", load_seq=1, vendor_key="甲", version="8"),
        reader_of("a/b", load_seq=1),
    )
    assert sorted((r.vendor_key, r.version) for r in readers.apply_reader_log(df).collect()) == sorted([("甲", "2"), ("丙", "1")])


def test_overview_and_orphans(spark):
    known = vendors(spark, (1, "甲"), (2, "乙"), (3, "丙"))
    df = catalog(spark, reader_of("甲"), reader_of("乙", target_fields=[]), reader_of("孤兒"))
    rows = {r.vendor_name: (r.installed, r.version, r.target_fields) for r in readers.reader_overview(known, df).collect()}
    assert rows == {"甲": (True, "1.0", "項次、單位"), "乙": (True, "1.0", "-"), "丙": (False, None, "-")}
    assert [r.vendor_key for r in readers.reader_orphans(known, df).collect()] == ["孤兒"]
    both = readers.reader_overview_all(known, df)
    assert sorted((r.kind, r.vendor_name or r.vendor_key) for r in both.collect()) == sorted([("vendor", "甲"), ("vendor", "乙"), ("vendor", "丙"), ("orphan", "孤兒")])


def test_bulk_install(spark):
    df = catalog(
        spark,
        {"file_name": "1"},
        {"file_name": "2", "vendor_key": "乙"},
        {"file_name": "3", "vendor_key": "無此家"},
        {"file_name": "4", "self_test": "false"},
    )
    results = readers.bulk_result_class(readers.bulk_install(df, vendors(spark, (5, "甲"), (3, "甲"), (9, "乙"))))
    got = {r.file_name: (r.ok, r.matched_vendor_id, r.result_class) for r in results.collect()}
    assert got == {"1": (True, 3, "submitted"), "2": (True, 9, "submitted"), "3": (False, None, "pending"), "4": (False, None, "overdue")}
    totals = readers.bulk_totals(results).collect()[0]
    assert (totals.ok_count, totals.total) == (2, 4)


def test_bundled_and_auto_created(spark):
    df = catalog(spark, {}, {"file_name": "x.txt", "vendor_key": "乙"}, {"file_name": "c.pmisparser.js", "vendor_key": "丙"}, {"file_name": "d.pmisparser.js", "has_parse": False})
    found = readers.bundled_readers(df, vendors(spark, (1, "甲")), catalog(spark, reader_of("丙")))
    assert sorted((r.vendor_key, r.vendor_exists, r.installed) for r in found.collect()) == sorted([("甲", True, False), ("丙", False, True)])
    assert sorted(r.name for r in readers.vendors_to_create(df, vendors(spark, (1, "甲"))).collect()) == ["丙"]


def test_installed_readers_are_named_after_their_key(spark):
    df = catalog(spark, {"file_name": "other.pmisparser.js"}, {"file_name": "乙.pmisparser.js", "vendor_key": "乙"})
    assert [r.vendor_key for r in lists.installed_readers(df).collect()] == ["乙"]
    assert [r.vendor_key for r in readers.reader_orphans(vendors(spark, (1, "甲"), (2, "乙")), df).collect()] == ["甲"]


def test_load_failures_empty_files_and_bad_expected_keys(spark):
    df = catalog(spark, {"load_ok": False}, {"file_name": "2"}, {"file_name": "3", "expected_key": "a/b"})
    df = df.withColumn("load_error", F.when(F.col("load_ok"), None).otherwise(F.lit("boom"))).withColumn("is_empty", F.col("file_name") == "2")
    got = {r.file_name: r.error for r in readers.validate_readers(df, "expected_key").collect()}
    assert got == {GOOD["file_name"]: "讀取檔無法載入:boom", "2": "讀取檔內容為空", "3": "廠商鍵不合法(須為非空廠商名稱,不含檔名危險字元)"}


# Reports ---------------------------------------------------------------------


def days(spark, *rows):
    """rows: (file_id, day_pos, date)"""
    df = spark.createDataFrame(list(rows), "file_id bigint, day_pos bigint, log_date_raw string")
    nothing = F.lit(None).cast("string")
    return df.select(
        "*", nothing.alias("project_name"), F.lit("三").alias("weekday"), F.lit("晴").alias("weather_am"), nothing.alias("weather_pm"), F.lit(0.5).alias("actual_pct")
    )


def submissions(spark, *rows):
    """rows: (id, period, type, file_id, vendor, reader, parse_error)"""
    return spark.createDataFrame(
        [(r[0], 7, *r[1:]) for r in rows],
        "submission_id bigint, project_id bigint, period string, type string, file_id bigint, vendor_name string, reader_key string, parse_error string",
    )


def test_outcomes_in_order(spark):
    d = days(spark, (1, 0, "2026-04-08"), (1, 1, "2026-05-01"), (1, 2, None), (2, 0, None))
    subs = submissions(
        spark,
        (1, "2026-04", "monthly", 1, None, None, "x"),
        (2, "2026-04", "monthly", 1, "v", None, "x"),
        (3, "2026-04", "monthly", 1, "v", "v", "x"),
        (4, "2026-01", "monthly", 1, "v", "v", None),
        (5, "2026-04", "monthly", 1, "v", "v", None),
        (6, "2026-01", "supervision", 1, "v", "v", None),
        (7, "2026-01", "monthly", 2, "v", "v", None),
        (8, "2026-01", "supervision", 99, "v", "v", None),
    )
    got = {r.submission_id: (r.report_generated, r.reason, r.n_days) for r in report.report_outcome(subs, d).collect()}
    assert [got[i][0] for i in range(1, 9)] == [False, False, False, False, True, True, False, False]
    assert got[1][1] == report.NO_VENDOR and got[2][1] == report.NO_READER and got[3][1] == "施工日誌解析失敗:x"
    assert got[4][1] == "此施工日誌沒有 2026-01 的資料;檔案內含月份:2026-04、2026-05。請改選其中一個月份再產生。"
    assert got[7][1] == got[8][1] == report.NO_DAYS
    assert (got[5][2], got[6][2]) == (1, 3)


def test_sheet_names_and_empty_report(spark):
    d = days(spark, (1, 3, "2026-04-08"), (1, 5, "2026-04-09"), (1, 6, "2027-04-08"), (1, 9, None), (1, 4097, "2026-04-08"), (1, 9000, "bad"))
    subs = submissions(spark, (1, "2026-04", "supervision", 1, "v", "v", None), (2, "2026-04", "monthly", 1, "v", "v", None), (3, "2020-01", "monthly", 1, "v", "v", None))
    rows = report.report_sheets(subs, d).collect()
    names = {i: [r.sheet_name for r in sorted(rows, key=lambda r: r.day_pos or 0) if r.submission_id == i] for i in (1, 2, 3)}
    assert names[1] == ["04-08", "04-09", "04-08_2", "第4天", "04-08_3", "第6天"]
    assert names[2] == ["04-08", "04-09", "04-08_2"]
    assert names[3] == ["監造報表"]


def test_lines_fill_amounts_and_display_blanks(spark):
    d = days(spark, (1, 0, "2026-04-08"))
    sheets = report.report_sheets(submissions(spark, (1, "2026-04", "monthly", 1, "v", "v", None)), d)
    items = spark.createDataFrame(
        [
            (1, 0, 0, "壹", "工", None, None, None, None, None, None),
            (1, 0, 1, "1", "a", "式", 33.335, 1.0, 2.0, None, 2.0),
            (1, 0, 2, "2", "b", "式", 1234.5, 1.0, 2.0, 7.0, 2.0),
        ],
        "file_id bigint, day_pos bigint, item_pos bigint, item_no string, item_name string, unit string, unit_price double, "
        "contract_qty double, today_qty double, today_amount double, cum_qty double",
    )
    lines = report.report_lines(sheets, items)
    assert [r.today_amount for r in lines.orderBy("item_pos").collect()] == [None, 66.67, 7.0]
    shown = report.lines_display(lines).orderBy("item_pos").collect()
    assert (shown[0].unit, shown[0].unit_price, shown[0].today_amount) == ("", "", "")
    assert (shown[1].today_amount, shown[2].unit_price) == ("66.67", "1,234.50")
    assert {r.sheet_name for r in shown} == {"04-08"}


def test_header_block(spark):
    project = spark.createDataFrame(
        [(7, "工程", None, 1000000.0, dt.date(2026, 4, 1), None)],
        "id bigint, name string, project_no string, award_amount double, start_date date, contract_completion_date date",
    )
    sheets = report.report_sheets(submissions(spark, (1, "2026-04", "monthly", 1, "v", "v", None)), days(spark, (1, 0, "2026-04-08")))
    block = report.report_header_block(sheets, report.report_project_header(project)).orderBy("pos").collect()
    got = {r.label: r.value for r in block}
    assert len(block) == 14 and block[0].label == "本日天氣　上午"
    assert (got["填報日期"], got["契約金額"], got["決標金額"], got["開工日期"]) == ("2026-04-08 (三)", "1000000", "1000000", "2026-04-01")
    assert (got["工程編號"], got["預定進度(%)"], got["實際進度(%)"], got["契約竣工日"]) == ("", "", "0.5", "")


def test_artifacts(spark):
    df = spark.createDataFrame([(1, "a/b", None), (2, None, "r"), (3, "../x", "")], "id int, daily_log_path string, report_path string")
    got = {(r.id, r.kind): r.status for r in report.artifact_availability(df).collect()}
    assert [got[i, "daily_log"] for i in (1, 2, 3)] == [200, 404, 400]
    assert [got[i, "report"] for i in (1, 2, 3)] == [409, 200, 409]
    assert {got[i, "official_doc"] for i in (1, 2, 3)} == {409}


def test_intake(spark):
    df = spark.createDataFrame([(1, " 2026-07 ", "supervision"), (2, "2026-13", None), (3, "2026/07", "x"), (4, None, "monthly")], "id int, period string, type string")
    got = {r.id: (r.period, r.type, r.accepted) for r in report.intake(df).collect()}
    assert got == {1: ("2026-07", "supervision", True), 2: ("2026-13", "monthly", False), 3: ("2026/07", "monthly", False), 4: ("", "monthly", False)}
    assert [(r.id, r.deadline) for r in report.ledger_rows(df, F.lit(10)).collect()] == [(1, "2026-07-10")]


def test_lines_sink(spark, tmp_path):
    d = days(spark, (1, 0, "2026-04-08"))
    sheets = report.report_sheets(submissions(spark, (1, "2026-04", "monthly", 1, "v", "v", None)), d)
    items = spark.createDataFrame([(1, 0, 0, "1", "a", "式", 2.0, 1.0, 2.0, None, 2.0)], "file_id bigint, day_pos bigint, item_pos bigint, item_no string, item_name string, unit string, unit_price double, contract_qty double, today_qty double, today_amount double, cum_qty double")
    report.write_report_lines(report.report_lines(sheets, items), str(tmp_path / "lines"))
    back = spark.read.parquet(str(tmp_path / "lines")).collect()
    assert [(r.period, r.type, r.today_amount) for r in back] == [("2026-04", "monthly", 4.0)]


def test_stream_appends_each_request_once(spark, tmp_path):
    when = dt.datetime(2026, 7, 1, 12)
    rows = [(1, 7, " 2026-07", "monthly", "a", when), (1, 7, "2026-07", "monthly", "a", when), (2, 7, "2026-13", "monthly", "b", when), (3, 8, "2026-06", "supervision", "c", when)]
    spark.createDataFrame(rows, stream.REQUEST).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        requests = stream.read_requests(spark, str(tmp_path / "in"))
        query = stream.append_to_ledger(stream.ledger_stream(requests, 5), str(tmp_path / "ledger"), str(tmp_path / "state"))
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "ledger")).collect()
    assert sorted((r.request_id, r.period, r.type, r.deadline) for r in got) == [(1, "2026-07", "monthly", "2026-07-05"), (3, "2026-06", "supervision", "2026-06-05")]


def test_stream_takes_late_requests_and_ignores_those_sent_again_later(spark, tmp_path):
    early, late = dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 20)

    def arrive(name, *rows):
        spark.createDataFrame(list(rows), stream.REQUEST).write.parquet(str(tmp_path / "in" / name))
        requests = stream.read_requests(spark, str(tmp_path / "in" / "*"))
        query = stream.append_to_ledger(stream.ledger_stream(requests, 5), str(tmp_path / "ledger"), str(tmp_path / "state"))
        query.awaitTermination(120)

    arrive("a", (1, 7, "2026-07", "monthly", "a", late))
    arrive("b", (2, 7, "2026-06", "monthly", "b", early), (1, 7, "2026-07", "monthly", "a", late + dt.timedelta(days=9)))
    got = spark.read.parquet(str(tmp_path / "ledger")).collect()
    assert sorted((r.request_id, r.submitted_at) for r in got) == [(1, late), (2, early)]
