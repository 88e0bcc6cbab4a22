"""Line lists, settings and the reader catalogue as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_vendor_key, trim_wide
from ..operators.ranking import latest

DEFAULT_SETTLEMENT_DAY = 5
READER_SUFFIX = ".pmisparser.js"


def import_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank trimmed lines with their place: (key, line_no, name)."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))
    return lines.select(key, "line_no", trim_wide("line").alias("name")).filter(F.length("name") > 0)


def leading_int(value: Column) -> Column:
    """Integer at the start of a text, as ``parseInt`` reads it."""
    return F.nullif(F.regexp_extract(trim_wide(value), r"^([+-]?\d+)", 1), F.lit("")).try_cast("int")


def valid_settlement_day(value: Column) -> Column:
    day = leading_int(value)
    return F.when(day.between(1, 28), day)


def settlement_day(settings: DataFrame) -> DataFrame:
    """Always exactly one row: the stored day when it is 1..28, else the default."""
    stored = settings.filter(F.col("key") == "settlement_day").agg(F.max("value").alias("value"))
    day = F.coalesce(valid_settlement_day(F.col("value")), F.lit(DEFAULT_SETTLEMENT_DAY))
    return stored.select(day.alias("settlement_day"))


def latest_settings(changes: DataFrame) -> DataFrame:
    """Upserted settings: the last accepted change per key.

    ``changes`` has (seq, key, value). A settlement day is accepted within 1..28 only and
    stored as plain integer text; other settings are stored as they are. Nulls are no change.
    """
    day = valid_settlement_day(F.col("value")).cast("string")
    value = F.when(F.col("key") == "settlement_day", day).otherwise(F.col("value"))
    accepted = changes.withColumn("value", value).filter(F.col("value").isNotNull())
    return latest(accepted.select("seq", "key", "value"), ["key"], ["seq", "value"]).select("key", "value")


def reader_catalog(readers: DataFrame) -> DataFrame:
    """Loadable reader files by their own key; the last file name wins a shared key."""
    is_reader = F.col("file_name").endswith(READER_SUFFIX)
    usable = readers.filter(is_reader & F.col("load_ok") & (F.col("vendor_key") != ""))
    return latest(usable, ["vendor_key"], ["file_name", "load_seq"])


def installed_readers(readers: DataFrame) -> DataFrame:
    """Readers that a vendor can use: a valid vendor key, in the file named after it."""
    own_file = F.col("file_name") == F.concat("vendor_key", F.lit(READER_SUFFIX))
    return reader_catalog(readers.filter(own_file)).filter(is_vendor_key("vendor_key"))
