"""Dates and periods on columns. Log dates stay ISO text; casting is left to the caller."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, _col, match_group, trim_wide

PERIOD = r"^\d{4}-\d{2}$"
REAL_PERIOD = r"^\d{4}-(0[1-9]|1[0-2])$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
TAIPEI = timezone(timedelta(hours=8))

# Weekday names, code 1 is Sunday.
WEEKDAYS = ["日", "一", "二", "三", "四", "五", "六"]

# Limits of the 1900 date system.
LAST_SERIAL = 2958465
PHANTOM_LEAP_SERIAL = 60


def pad2(value: Column | str) -> Column:
    text = _col(value).cast("string")
    return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))


def iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), pad2(month), F.lit("-"), pad2(day))


def local_now(as_of: datetime | str | None) -> datetime:
    """Wall clock in Taipei for an instant with an offset; the present when none is given."""
    if as_of is None:
        moment = datetime.now(timezone.utc)
    else:
        moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    if moment.tzinfo is None:
        raise ValueError("as_of needs a UTC offset")
    return moment.astimezone(TAIPEI).replace(tzinfo=None)


def deadline_day(day: Column | str) -> Column:
    """Two digits of a settlement day held within 1..28; no day means the first."""
    d = _col(day).cast("int")
    chosen = F.when(d.isNull() | (d == 0), F.lit(1)).otherwise(d)
    return pad2(F.least(F.greatest(chosen, F.lit(1)), F.lit(28)))


def deadline(period: Column | str, day: Column | str) -> Column:
    p = _col(period)
    return F.when(p.rlike(PERIOD), F.concat(p, F.lit("-"), deadline_day(day)))


def period_of(iso_date: Column | str) -> Column:
    """Month of a strict ISO date text."""
    d = _col(iso_date)
    return F.when(d.rlike(ISO_DATE), F.substring(d, 1, 7))


def month_of(moment: Column | str) -> Column:
    return F.substring(F.to_date(_col(moment)).cast("string"), 1, 7)


def month_number(day: Column) -> Column:
    """Months since year 0, so that a month range is an integer range."""
    return F.year(day) * 12 + F.month(day) - 1


def base_month(start: Column, created: Column, as_of: datetime | str | None = None) -> Column:
    """Month a project's grid begins with: its start, else its creation, else now."""
    return month_of(F.coalesce(F.to_date(start), F.to_date(created), F.lit(local_now(as_of).date())))


def period_text(month: Column) -> Column:
    return F.concat(F.lpad(((month - month % 12) / 12).cast("int").cast("string"), 4, "0"), F.lit("-"), pad2(month % 12 + 1))


def excel_date(serial: Column | str) -> Column:
    """Serial day number of the 1900 date system to ISO text.

    The system counts a 29 February 1900 that never was: serial 60. Serial 0 is its
    day zero of January 1900. A time within 0.1 ms of midnight counts as the next day.
    """
    n = _col(serial).cast("double")
    whole = F.floor(n)
    tick = F.when((n - whole) * 86400 > 86399.9999, whole + 1).otherwise(whole).cast("int")
    text = (
        F.when(tick == PHANTOM_LEAP_SERIAL, F.lit("1900-02-29"))
        .when(tick == 0, F.lit("1900-01-00"))
        .when(tick < PHANTOM_LEAP_SERIAL, F.date_add(F.lit("1899-12-31").cast("date"), tick).cast("string"))
        .otherwise(F.date_add(F.lit("1899-12-30").cast("date"), tick).cast("string"))
    )
    return F.when((n >= 0) & (n <= LAST_SERIAL), text)


def roc_date(year: Column, month: Column, day: Column) -> Column:
    """Year of the Republic to ISO text."""
    return iso(year.try_cast("bigint") + 1911, month.try_cast("bigint"), day.try_cast("bigint"))


def date_text(value: Column | str) -> Column:
    """Dates written in either calendar to ISO text; no range check, as in the source logs."""
    t = trim_wide(value)
    chinese = rf"(\d{{2,4}}){BLANK}*年{BLANK}*(\d{{1,2}}){BLANK}*月{BLANK}*(\d{{1,2}}){BLANK}*日"
    western = r"(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})"
    short = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2})$"

    def part(pattern: str, group: int) -> Column:
        return match_group(t, pattern, group).try_cast("int")

    year = part(chinese, 1)
    return F.coalesce(
        iso(F.when(year < 1911, year + 1911).otherwise(year), part(chinese, 2), part(chinese, 3)),
        iso(match_group(t, western, 1), part(western, 2), part(western, 3)),
        iso(part(short, 3) + 2000, part(short, 1), part(short, 2)),
    )


def cell_date(num: Column, text: Column) -> Column:
    # Dates are serials as a rule. As a lambda the many steps of a written date stay out of the generated method, which
    # from 8,000 bytes on the JVM never compiles.
    written = F.get(F.transform(F.array(text), date_text), F.lit(0))
    return F.when(num.isNotNull(), excel_date(num)).otherwise(written)


def weekday_name(code: Column | str) -> Column:
    """Code 1..7 to a one-character weekday, anything else null."""
    c = _col(code).cast("double")
    names = F.array(*[F.lit(w) for w in WEEKDAYS])
    return F.when(c.between(1, 7) & (c == F.floor(c)), F.get(names, (c - 1).cast("int")))


def date_with_weekday(iso_date: Column | str, weekday: Column | str) -> Column:
    w = _col(weekday)
    tail = F.when(w.isNotNull() & (w != ""), F.concat(F.lit("("), w, F.lit(")"))).otherwise(F.lit(""))
    return trim_wide(F.concat(F.coalesce(_col(iso_date), F.lit("")), F.lit(" "), tail))
