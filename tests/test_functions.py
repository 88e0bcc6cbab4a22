"""Scalar functions against golden and boundary cases."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from siteledger.functions import dates, numbers, text
from siteledger.sources.lists import leading_int, settlement_day


def lits(*items, kind="string"):
    return [F.lit(i).cast(kind) for i in items]


def test_half_up_whole(values):
    got = values(*[numbers.round_half_up(c) for c in lits(0.5, 1.5, 2.5, 30.5, 30.4, 30.6, -2.5, None, kind="double")])
    assert got == [1, 2, 3, 31, 30, 31, -3, None]


def test_half_up_two_places(values):
    got = values(*[numbers.round_half_up(c, 2) for c in lits(2250.005, 33.335 * 2, 1.005, float("nan"), None, kind="double")])
    assert got == [2250.01, 66.67, 1.0, None, None]


def test_half_up_huge_values_do_not_saturate(values):
    assert values(numbers.round_half_up(F.lit(1e300), 2), numbers.round_half_up(F.lit(-1e19))) == [1e300, -1e19]


def test_half_up_decimal_mode(values):
    assert float(values(numbers.round_half_up_decimal(F.lit("1.005").cast("decimal(10,4)"), 2))[0]) == 1.01


def fee_cases():
    def case(kind, amount, award, pct):
        args = [F.lit(kind).cast("string"), *lits(amount, award, pct, kind="double")]
        return numbers.design_fee(*args), numbers.fee_unbid(args[0], args[2])

    return case


def test_design_fee(values):
    case = fee_cases()
    cases = [
        case("lump_sum", 500000, None, None),
        case("pct", None, 1234567, 2.5),
        case("pct", None, 100, 2.5),
        case("pct", None, None, 2.5),
        case("pct", None, 100, None),
        case("other", 1, 1, 1),
        case(None, 1, 1, 1),
    ]
    got = values(*[c for pair in cases for c in pair])
    assert got[0::2] == [500000, 30864, 3, None, None, None, None]
    assert got[1::2] == [False, False, False, True, False, False, False]


def test_amount_fill(values):
    got = values(
        numbers.filled_amount(*lits(None, 33.335, 2, kind="double")),
        numbers.filled_amount(*lits(7, 33.335, 2, kind="double")),
        numbers.filled_amount(*lits(None, None, 2, kind="double")),
    )
    assert got == [66.67, 7.0, None]


def test_deadline(values):
    cases = [("2026-07", 5), ("2026-01", 10), ("2026/07", 5), ("2026-07", 0), ("2026-07", None), ("2026-07", 31), ("2026-07", -3), (None, 5)]
    got = values(*[dates.deadline(F.lit(p).cast("string"), F.lit(d).cast("int")) for p, d in cases])
    assert got == ["2026-07-05", "2026-01-10", None, "2026-07-01", "2026-07-01", "2026-07-28", "2026-07-01", None]


def test_period_of(values):
    got = values(*[dates.period_of(c) for c in lits("2026-04-08", "2026-4-8", "2026-04-08T00", "2026-13-99", None)])
    assert got == ["2026-04", None, None, "2026-13", None]


def test_excel_date(values):
    cases = [46174, 46099, 61, 60, 59, 1, 0, -1, 46174.5, 46174.999999999, 2958465, 2958466, None, float("nan")]
    got = values(*[dates.excel_date(c) for c in lits(*cases, kind="double")])
    assert got == [
        "2026-06-01", "2026-03-18", "1900-03-01", "1900-02-29", "1900-02-28", "1900-01-01", "1900-01-00", None,
        "2026-06-01", "2026-06-02", "9999-12-31", None, None, None,
    ]


def test_date_text(values):
    cases = [
        "115 年 4 月 8 日", "民國115年04月08日", "2026年6月1日", "on 2026/6/1", "2026-06-01", "2026.6.1 x", "6/1/26", "　6-1-26 ",
        "x 6/1/26", "2026-13-45", "", "n/a", None,
    ]
    got = values(*[dates.date_text(c) for c in lits(*cases)])
    assert got == [
        "2026-04-08", "2026-04-08", "2026-06-01", "2026-06-01", "2026-06-01", "2026-06-01", "2026-06-01", "2026-06-01",
        None, "2026-13-45", None, None, None,
    ]


def test_cell_date(values):
    got = values(
        dates.cell_date(F.lit(46174.0), F.lit("46174")),
        dates.cell_date(F.lit(None).cast("double"), F.lit("115年6月1日")),
        dates.cell_date(F.lit(None).cast("double"), F.lit(None).cast("string")),
    )
    assert got == ["2026-06-01", "2026-06-01", None]


def test_weekday(values):
    got = values(*[dates.weekday_name(c) for c in lits(1, 4, 7, 0, 8, 2.5, None, kind="double")])
    assert got == ["日", "三", "六", None, None, None, None]


def test_date_with_weekday(values):
    got = values(
        dates.date_with_weekday(F.lit("2026-04-08"), F.lit("三")),
        dates.date_with_weekday(F.lit("2026-04-08"), F.lit(None).cast("string")),
        dates.date_with_weekday(F.lit(None).cast("string"), F.lit("三")),
        dates.date_with_weekday(F.lit(None).cast("string"), F.lit("")),
    )
    assert got == ["2026-04-08 (三)", "2026-04-08", "(三)", ""]


def test_local_now_needs_an_offset():
    assert dates.local_now("2026-07-04T16:00:00+00:00").isoformat() == "2026-07-05T00:00:00"
    with pytest.raises(ValueError):
        dates.local_now("2026-07-05T00:00:00")


def test_number_parsing(values):
    cases = ["2,250", "1.00", "-", "－", "　12 ", ".5", "5.", "1e3", "1d", "Infinity", "NaN", "0x10", "1e999", "--1", "#REF!", "", None, "+7", "1,2,3"]
    got = values(*[text.to_number(c) for c in lits(*cases)])
    assert got == [2250, 1, None, None, 12, 0.5, 5, 1000, None, None, None, None, None, None, None, None, None, 7, 123]


def test_marks_and_texts(values):
    cases = ["", " ", "-", "–", "—", "－", "　-　", None, "0", "x"]
    assert values(*[text.is_no_data(c) for c in lits(*cases)]) == [True] * 8 + [False] * 2
    assert values(*[text.to_text(c) for c in lits(" a　", "-", "", None, "#N/A")]) == ["a", None, None, None, "#N/A"]
    assert values(*[text.to_text(c, error_tokens=True) for c in lits("#N/A", "$AA", "a", "aaa")]) == [None, None, "a", None]


def test_error_tokens(values):
    cases = ["#REF!", "#VALUE!", "#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "aa", "$Aaa", " #REF! ", "a", "#ref!", "aab", None]
    assert values(*[text.is_error_token(c) for c in lits(*cases)]) == [True] * 10 + [False] * 4


def test_item_ids(values):
    cases = ["壹", "拾", "1", "99", "100", "1.", "拾壹", "", None]
    assert values(*[text.is_page_item_id(c) for c in lits(*cases)]) == [True] * 4 + [False] * 5

    def sheet(num, txt):
        return text.is_sheet_item_id(F.lit(num).cast("double"), F.lit(txt).cast("string"))

    got = values(sheet(1, "1"), sheet(0, "0"), sheet(1.5, "1.5"), sheet(-1, "-1"), sheet(None, " 100 "), sheet(None, "1000"), sheet(None, "陸"), sheet(None, None))
    assert got == [True, False, False, False, True, False, True, False]


def test_units(values):
    cases = ["面", "公尺", "M", "M2", "CM", "m2", "2M", "M2X", "", None]
    assert values(*[text.is_unit(c) for c in lits(*cases)]) == [True] * 5 + [False] * 5


def test_vendor_keys(values):
    cases = ["測試廠商", "ABC Co", "x" * 100, "", "x" * 101, ".", "..", "a/b", "a\\b", " 甲", "甲　", "a\tb", "a:b", None]
    assert values(*[text.is_vendor_key(c) for c in lits(*cases)]) == [True] * 3 + [False] * 11


def test_vendor_key_counts_utf16_units(values):
    astral = "\U00020000"
    assert values(text.is_vendor_key(F.lit(astral * 50)), text.is_vendor_key(F.lit(astral * 51))) == [True, False]


def test_paths(values):
    inside = ["uploads/proj_1/x.pdf", "a/../b", "./a", "a//b", "a/.hidden"]
    outside = ["../secret.txt", "uploads/../../../secret.txt", "/etc/passwd", "", None, ".", "a/..", "..hidden", "../data/x"]
    assert values(*[text.is_inside_root(c) for c in lits(*inside)]) == [True] * len(inside)
    assert values(*[text.is_inside_root(c) for c in lits(*outside)]) == [False] * len(outside)


def test_file_and_sheet_names(values):
    mojibake = "測試.pdf".encode().decode("latin1")
    got = values(
        text.reread_latin1_as_utf8(F.lit(mojibake)),
        text.reread_latin1_as_utf8(F.lit("plain.pdf")),
        text.safe_file_name(F.lit('a\\b/c:d*e?f"g<h>i|j')),
        text.safe_sheet_name(F.lit("a/b[c]:d"), F.lit("f")),
        text.safe_sheet_name(F.lit(" 　"), F.lit("f")),
        text.safe_sheet_name(F.lit(None).cast("string"), F.lit("f")),
        text.safe_sheet_name(F.lit("x" * 40), F.lit("f")),
    )
    assert got == ["測試.pdf", "plain.pdf", "a_b_c_d_e_f_g_h_i_j", "a-b-c--d", "f", "f", "x" * 31]


def test_bad_utf8_becomes_replacement(values):
    got = values(text.reread_latin1_as_utf8(F.lit("\xff.pdf")))[0]
    assert got == b"\xff.pdf".decode("utf8", errors="replace")


def test_column_letters_round_trip(values):
    cases = {0: "A", 25: "Z", 26: "AA", 34: "AI", 70: "BS", 134: "EE", 170: "FO", 234: "IA", 701: "ZZ", 702: "AAA", 16383: "XFD"}
    assert values(*[text.column_letters(F.lit(i)) for i in cases]) == list(cases.values())
    assert values(*[text.column_index(F.lit(s.lower())) for s in cases.values()]) == list(cases)
    assert [text.column_number(s) for s in cases.values()] == list(cases)


def test_nfkc_of_many_texts(spark):
    """Every character by itself and between others, and mixtures, against the standard library."""
    blocks = [chr(c) for first, last in [(1, 0x600), (0x1100, 0x11FF), (0x1E00, 0x2600), (0x3000, 0x3400), (0xAC00, 0xAC40), (0xF900, 0xFB10), (0xFE00, 0x10000)] for c in range(first, last)]
    rng = random.Random(5)
    texts = blocks + [f"a{c}e" for c in blocks] + ["".join(rng.choices(blocks, k=6)) for _ in range(3000)] + ["工程名稱：甲　乙", "e\u0301", "가\u11a8", "ｶﾞ", "", "𝐀①"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", text.nfkc("t").alias("t"))
    wrong = [(n, texts[n]) for n, t in df.collect() if t != unicodedata.normalize("NFKC", texts[n])]
    assert wrong == []


def test_plain_texts_do_not_cross_to_python(values):
    *_, known = text._nfkc_table()
    shown = "第１頁：工程名稱　日期（三） １２３，４５６．７８ Àé ü カナ ABC-12\n"
    assert values(F.lit(shown).rlike(known), F.lit("e\u0301").rlike(known), F.lit("①㎡").rlike(known)) == [True, False, False]


def test_texts_to_normalise_are_not_looked_up_in_the_jvm(spark):
    df = spark.createDataFrame([("Ａ　ｂ",)], "t string").select(text.nfkc("t").alias("t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and df.first().t == "A b"


def test_nfkc(values):
    assert values(text.nfkc(F.lit("Ａ１：（年年）")), text.nfkc(F.lit(None).cast("string"))) == ["A1:(年年)", None]


def test_strip_label(values):
    got = values(*[text.strip_project_label(c) for c in lits("工程名稱:甲", "工程名稱 ： 甲", "甲", "工程名稱:", None)])
    assert got == ["甲", "甲", "甲", None, None]


def test_number_text(values):
    assert values(*[text.number_as_text(c) for c in lits(12, 0.5, -3, None, kind="double")]) == ["12", "0.5", "-3", None]


def test_settlement_day(spark, values):
    assert values(*[leading_int(c) for c in lits("7abc", " 12", "-3", "abc", "", None)]) == [7, 12, -3, None, None, None]

    def stored(*rows):
        df = spark.createDataFrame(list(rows), "key string, value string")
        return settlement_day(df).collect()[0][0]

    assert [stored(), stored(("settlement_day", "10")), stored(("settlement_day", "0"))] == [5, 10, 5]
    assert [stored(("settlement_day", "29")), stored(("other", "9")), stored(("settlement_day", "28x"))] == [5, 5, 28]


def test_half_up_against_the_formula(spark):
    rng = random.Random(7)
    data = [(rng.uniform(-1e6, 1e6) if rng.random() < 0.7 else round(rng.uniform(-999, 999), 3),) for _ in range(500)]
    rows = spark.createDataFrame(data, "v double").select("v", numbers.round_half_up("v", 2).alias("r")).collect()
    for v, r in rows:
        assert r == math.copysign(math.floor(abs(v) * 100 + 0.5 + 2.220446049250313e-16) / 100, v)


def test_numbers_are_written_in_plain_digits(values):
    numbers = [12345678.5, 0.0005, -1.5e-6, 3.0, 0.25, -0.0, 1e20, 123456789012345680.0, 1e21, 1.25e-7, 2**53 + 2.0, -98765432.125]
    want = ["12345678.5", "0.0005", "-0.0000015", "3", "0.25", "0", "100000000000000000000", "123456789012345680", "1e+21", "1.25e-7", "9007199254740994", "-98765432.125"]
    assert values(*[text.number_as_text(F.lit(n)) for n in numbers]) == want
