"""Text predicates and cleaners on columns.

Blanks follow the ECMAScript whitespace set, which (unlike Java's) includes the
ideographic space and the byte-order mark.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Whitespace characters of ECMAScript.
BLANK_CHARS = "\t\n\x0b\x0c\r " + "\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
BLANK_CHARS += "\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
INK = BLANK.replace("[", "[^", 1)

# Marks that mean "no data".
NO_DATA_MARKS = ["", "-", "–", "—", "－"]

# Spreadsheet error tokens.
ERROR_TOKENS = ["#REF!", "#VALUE!", "#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!"]
ERROR_FILLER = r"(?i)^\$?a{2,}$"

# Formal Chinese numerals used as item ids.
CJK_ITEM_IDS = ["壹", "貳", "參", "肆", "伍", "陸", "柒", "捌", "玖", "拾"]

# Units of measure recognised in text logs.
UNITS = ["面", "式", "組", "間", "處", "座", "個", "支", "片", "公尺", "公斤", "噸"]

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BARE_NUMBER = NUMBER.replace("$", r"\z")
MAX_KEY_UNITS = 100


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_wide(value: Column | str) -> Column:
    return F.btrim(_col(value), F.lit(BLANK_CHARS))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(""))


def match_group(value: Column | str, pattern: str, group: int) -> Column:
    """A regex group, null when the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(_col(value), pattern, group), F.lit(""))


def is_no_data(value: Column | str) -> Column:
    v = _col(value)
    return v.isNull() | trim_wide(v).isin(NO_DATA_MARKS)


def is_error_token(value: Column | str) -> Column:
    t = trim_wide(value)
    return F.coalesce(t.isin(ERROR_TOKENS) | t.rlike(ERROR_FILLER), F.lit(False))


def parse_number(value: Column | str) -> Column:
    """Finite double after dropping thousands commas, else null."""
    v = _col(value)
    t = trim_wide(F.replace(v, F.lit(","), F.lit("")))
    # Most texts are bare numbers, for which nothing is dropped.
    number = F.when(v.rlike(BARE_NUMBER), v.try_cast("double")).when(v.rlike(r"\d"), F.when(t.rlike(NUMBER), t.try_cast("double")))
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def to_number(value: Column | str) -> Column:
    """Number in a cell or token; no-data marks and error tokens are no numbers, so null."""
    return parse_number(value)


def to_text(value: Column | str, error_tokens: bool = False) -> Column:
    v = _col(value)
    missing = is_no_data(v) | is_error_token(v) if error_tokens else is_no_data(v)
    return F.when(~missing, trim_wide(v))


def number_as_text(value: Column | str) -> Column:
    """Shortest text of a double in plain digits, whole numbers without a fraction.

    From 1e21 on, and below 1e-6, it is written like ``1.5e+21``.
    """
    v = _col(value).cast("double")
    written = v.cast("string")  # shortest digits, with an exponent from 1e7 on and below 1e-3
    far = F.replace(F.replace(F.replace(written, F.lit(".0E"), F.lit("E")), F.lit("E-"), F.lit("e-")), F.lit("E"), F.lit("e+"))
    # at most 17 digits: ten places hold what is behind the point of a number from 1e7 on
    digits = F.when(F.abs(v) >= 1, written.try_cast("decimal(38,10)").cast("string")).otherwise(written.try_cast("decimal(38,24)").cast("string"))
    spelled = F.when((F.abs(v) >= 1e21) | (F.abs(v) < 1e-6), far).otherwise(F.regexp_replace(digits, r"\.?0+$", ""))
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    # Whole numbers and those written without an exponent are told first and need no search of their text.
    return F.when(whole, v.cast("bigint").cast("string")).when((F.abs(v) >= 1e-3) & (F.abs(v) < 1e7), written).otherwise(spelled)


def is_page_item_id(token: Column | str) -> Column:
    t = _col(token)
    return F.coalesce(t.isin(CJK_ITEM_IDS) | t.rlike(r"^\d{1,2}$"), F.lit(False))


def is_sheet_item_id(num: Column, text: Column) -> Column:
    """Item id in a cell: a positive whole number, or a short digit or numeral text."""
    t = trim_wide(text)
    by_number = (num > 0) & (num == F.floor(num))
    by_text = t.isin(CJK_ITEM_IDS) | t.rlike(r"^\d{1,3}$")
    return F.coalesce(F.when(num.isNotNull(), by_number).otherwise(by_text), F.lit(False))


def is_unit(token: Column | str) -> Column:
    t = _col(token)
    return F.coalesce(t.isin(UNITS) | t.rlike(r"^[A-Z]+\d*$"), F.lit(False))


def strip_project_label(value: Column | str) -> Column:
    return blank_to_null(F.regexp_replace(_col(value), f"^工程名稱{BLANK}*[:：]{BLANK}*", ""))


def safe_sheet_name(value: Column | str, fallback: Column | str) -> Column:
    cleaned = trim_wide(F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"[\\/?*\[\]:]", "-"))
    return F.substring(F.when(cleaned == "", _col(fallback)).otherwise(cleaned), 1, 31)


def safe_file_name(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), r'[\\/:*?"<>|]', "_")


def reread_latin1_as_utf8(value: Column | str) -> Column:
    """Take the low byte of each UTF-16 unit and read the bytes as UTF-8."""
    units = F.hex(F.encode(_col(value), "UTF-16BE"))
    return F.make_valid_utf8(F.unhex(F.regexp_replace(units, "..(..)", "$1")).cast("string"))


def utf16_length(value: Column | str) -> Column:
    return (F.length(F.encode(_col(value), "UTF-16BE")) / 2).cast("int")


def is_vendor_key(value: Column | str) -> Column:
    v = _col(value)
    ok = (
        utf16_length(v).between(1, MAX_KEY_UNITS)
        & (v == trim_wide(v))
        & ~v.isin(".", "..")
        & ~v.rlike(r'[\\/:*?"<>|\x00-\x1f]')
    )
    return F.coalesce(ok, F.lit(False))


def is_inside_root(path: Column | str) -> Column:
    """A relative path that never climbs above the data root and does not end at it."""
    p = _col(path)
    root = F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), stack)
            .when((part == "..") & (F.size(stack) > 0), F.slice(stack, 1, F.size(stack) - 1))
            .when(part == "..", F.lit(None).cast("array<string>"))
            .otherwise(F.concat(stack, F.array(part)))
        )

    left = F.aggregate(F.split(p, "/"), root, step)
    walked = ~p.startswith("/") & (F.size(left) > 0) & ~F.try_element_at(left, F.lit(1)).startswith("..")
    # Only paths that step up need the walk; for the rest the first real part decides.
    plain = p.rlike(r"^(?:\./+)*+(?!\.\.|\.$)[^/]")
    return F.coalesce(F.when(p.rlike(r"(?:^|/)\.\.(?:/|$)"), walked).otherwise(plain), F.lit(False))


def column_index(letters: Column | str) -> Column:
    """Spreadsheet column letters to a 0-based index."""
    chars = F.filter(F.split(F.upper(_col(letters)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1


def column_letters(index: Column | str) -> Column:
    """0-based index to spreadsheet column letters (seven letters are enough for any int)."""
    start = F.struct((_col(index).cast("bigint") + 1).alias("n"), F.lit("").alias("s"))

    def step(acc: Column, _: Column) -> Column:
        letter = F.char((acc["n"] - 1) % 26 + 65)
        return F.when(
            acc["n"] > 0,
            F.struct(F.floor((acc["n"] - 1) / 26).alias("n"), F.concat(letter, acc["s"]).alias("s")),
        ).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["s"])


def column_number(letters: str) -> int:
    """The same mapping for a fixed address, evaluated while the plan is built."""
    index = 0
    for letter in letters:
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


# Blocks whose characters are looked up, as first and last code point. They hold
# what logs are written with: Latin letters, punctuation, Greek, kana, CJK, compatibility forms.
NFKC_BLOCKS = [(0x4E00, 0x9FFF), (0x0000, 0x024F), (0x0391, 0x03C9), (0x2000, 0x22FF), (0x2460, 0x257F), (0x3000, 0x30FF), (0x3400, 0x4DBF), (0xFF00, 0xFFEF)]


@functools.cache
def _nfkc_table() -> tuple[str, str]:
    """(pattern of texts made of plain characters, pattern of texts made of these and of characters with one plain form).

    A character is plain if it is normal by itself and neither a combining mark nor the
    second half of a composition: then a run of such characters is normal as it stands.
    """
    halves = {d.split()[1] for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    joins = {int(h, 16) for h in halves} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))

    def plain(c: str) -> bool:
        return unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) and ord(c) not in joins

    codes = [c for first, last in NFKC_BLOCKS for c in range(first, last + 1)]
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in codes}
    single = {c for c, f in forms.items() if c != f and len(f) == 1 and plain(f)}

    def ranges(chosen: Iterable[int]) -> str:
        """Runs of code points, in the order of the blocks, so that common ones are tried first."""
        runs: list[list[int]] = []
        for code in chosen:
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
        return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)

    def made_of(chosen: Iterable[int]) -> str:
        # ASCII and unified ideographs, which make up most texts, are told apart before the long lists.
        return rf"\A[\x00-\x7F\x{{4E00}}-\x{{9FFF}}[{ranges(chosen)}]]*+\z"

    normal = [c for c in codes if forms[chr(c)] == chr(c) and plain(chr(c))]
    held = set(normal)
    return made_of(normal), made_of(c for c in codes if chr(c) in single or c in held)


def nfkc(text: Column | str) -> Column:
    """Unicode NFKC, for which Spark has no built-in.

    ASCII texts, and those of characters that need and join nothing, are normal as they
    stand; other texts cross to Python, in Arrow batches: looked up character by character
    in the JVM they take several times as long. The helper is nested so that it ships by
    value and workers need no copy of the package.
    """

    def normalize(batch: pd.Series) -> pd.Series:
        import unicodedata

        def one(s):
            return s if unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s)

        return batch.map(one, na_action="ignore")

    normal, _ = _nfkc_table()
    given = _col(text)
    crosses = (F.octet_length(given) > F.length(given)) & ~given.rlike(normal)
    return F.coalesce(F.pandas_udf(normalize, StringType())(F.when(crosses, given)), given)


def any_of(values: Iterable[str]) -> str:
    """Alternation of literal values for a regex."""
    return "|".join(values)
