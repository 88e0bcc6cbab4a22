"""The catalogue of extraction readers: validation, installation, matching to vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, is_vendor_key
from ..sources.lists import READER_SUFFIX, installed_readers, reader_catalog
from .ranking import latest

UNMATCHED = "unmatched:查無同名廠商"


def validation_error(expected_key: Column) -> Column:
    """Message of the first failing rule, null for a sound reader.

    Reads the catalogue columns load_ok, has_meta, vendor_key, version, target_fields_is_list,
    has_parse and self_test ('none', 'true', 'false', 'error', 'not_function'), and those
    that ``with_load_state`` adds. A file that loads with an error names it; one that
    loads but exports nothing has load_ok false and no load_error.
    """
    key = F.col("vendor_key")
    test = F.coalesce(F.col("self_test"), F.lit("none"))
    mismatch = F.concat(
        F.lit("讀取檔廠商鍵("), key, F.lit(")與此廠商("), F.coalesce(expected_key, F.lit("")), F.lit(")不符,避免裝錯家")
    )
    # Messages of the rules, in the order they are checked.
    return (
        F.when(F.coalesce(F.col("is_empty"), F.lit(False)), F.lit("讀取檔內容為空"))
        .when(F.col("load_error").isNotNull(), F.concat(F.lit("讀取檔無法載入:"), "load_error"))
        .when(~F.coalesce(F.col("load_ok"), F.lit(False)), F.lit("讀取檔未匯出有效內容"))
        .when(~F.coalesce(F.col("has_meta"), F.lit(False)), F.lit("讀取檔缺少 meta"))
        .when(key.isNull() | (key == ""), F.lit("讀取檔 meta 缺少 vendorKey"))
        .when(~is_vendor_key(key), F.lit("讀取檔 meta.vendorKey 不是合法廠商名稱(空白/含危險字元/過長)"))
        .when(~key.eqNullSafe(expected_key), mismatch)
        .when(F.coalesce(F.col("version"), F.lit("")) == "", F.lit("讀取檔 meta 缺少 version"))
        .when(~F.coalesce(F.col("target_fields_is_list"), F.lit(False)), F.lit("讀取檔 meta.targetFields 須為陣列"))
        .when(~F.coalesce(F.col("has_parse"), F.lit(False)), F.lit("讀取檔缺少 parse function"))
        .when(test == "not_function", F.lit("讀取檔 selfTest 須為 function"))
        .when(test == "error", F.concat(F.lit("讀取檔 selfTest 執行失敗:"), F.coalesce("self_test_error", F.lit(""))))
        .when(test == "false", F.lit("讀取檔 selfTest 未通過(內附驗證失敗)"))
    )


def with_load_state(readers: DataFrame) -> DataFrame:
    """Adds is_empty (false) and load_error (null) where the catalogue has no such column."""
    defaults = {"is_empty": F.lit(False), "load_error": F.lit(None).cast("string")}
    return readers.withColumns({name: value for name, value in defaults.items() if name not in readers.columns})


def validate_readers(readers: DataFrame, expected_key: str = "vendor_key") -> DataFrame:
    """Each reader with ok and error; ``expected_key`` names the column it must match.

    An expected key other than the reader's own must be a valid vendor key itself.
    """
    error = validation_error(F.col(expected_key))
    if expected_key != "vendor_key":
        bad_key = ~F.coalesce(is_vendor_key(F.col(expected_key)), F.lit(False))
        error = F.when(bad_key, F.lit("廠商鍵不合法(須為非空廠商名稱,不含檔名危險字元)")).otherwise(error)
    checked = with_load_state(readers).withColumn("error", error)
    return checked.withColumn("ok", F.col("error").isNull())


def apply_reader_log(log: DataFrame, expected_key: str = "expected_key") -> DataFrame:
    """Install, overwrite and remove as one change log: valid installs only, last one wins.

    ``expected_key`` names the column of the vendor a reader is installed for or removed
    from; a reader made for another vendor is refused and leaves that vendor's reader be.
    """
    checked = validate_readers(log, expected_key).withColumn("vendor_key", F.col(expected_key))
    install = (F.col("op") == "install") & F.col("ok")
    effective = checked.filter(install | ((F.col("op") == "remove") & is_vendor_key("vendor_key")))
    return latest(effective, ["vendor_key"], ["load_seq"]).filter(F.col("op") == "install").drop("op", "ok", "error")


def vendor_ids_by_name(vendors: DataFrame) -> DataFrame:
    """One id per vendor name; names may repeat, the smallest id stands for them."""
    return vendors.groupBy(F.col("name").alias("vendor_key")).agg(F.min("id").alias("matched_vendor_id"))


def project_readers(project_vendors: DataFrame, readers: DataFrame) -> DataFrame:
    """Projects with the version of their vendor's reader, null when none is installed."""
    usable = installed_readers(readers).select(F.col("vendor_key").alias("vendor_name"), F.col("version").alias("reader_version"))
    return project_vendors.join(usable, "vendor_name", "left")


def reader_states(vendors: DataFrame, readers: DataFrame) -> DataFrame:
    """All vendors with the state of their reader."""
    usable = installed_readers(readers).select("vendor_key", "version", "target_fields", "installed_at")
    shown = F.coalesce(blank_to_null(F.array_join("target_fields", "、")), F.lit("-"))
    return vendors.join(usable, vendors["name"] == usable["vendor_key"], "left").select(
        vendors["id"].alias("vendor_id"),
        vendors["name"].alias("vendor_name"),
        usable["vendor_key"].isNotNull().alias("installed"),
        "version",
        shown.alias("target_fields"),
        "installed_at",
    )


def reader_overview(vendors: DataFrame, readers: DataFrame) -> DataFrame:
    """The same, sorted by vendor name."""
    return reader_states(vendors, readers).orderBy("vendor_name")


def reader_orphans(vendors: DataFrame, readers: DataFrame) -> DataFrame:
    """Readers that serve no vendor: no vendor has their key as name, or their file is not named after it."""
    catalog = reader_catalog(readers).select("vendor_key", "version", "target_fields", "file_name")
    own_file = F.col("file_name") == F.concat("vendor_key", F.lit(READER_SUFFIX))
    names = vendors.select("name").filter(is_vendor_key("name"))
    return catalog.join(names, own_file & (F.col("vendor_key") == names["name"]), "left_anti").drop("file_name")


def reader_overview_all(vendors: DataFrame, readers: DataFrame) -> DataFrame:
    """Vendors and orphans in one table with a kind column."""
    shown = F.coalesce(blank_to_null(F.array_join("target_fields", "、")), F.lit("-"))
    orphans = reader_orphans(vendors, readers).select(
        F.lit("orphan").alias("kind"), "vendor_key", "version", shown.alias("target_fields")
    )
    known = reader_states(vendors, readers).withColumn("kind", F.lit("vendor"))
    return known.unionByName(orphans, allowMissingColumns=True)


def bulk_match(uploads: DataFrame, vendors: DataFrame) -> DataFrame:
    """Valid uploads with the vendor of the same name, or an unmatched error."""
    matched = uploads.join(vendor_ids_by_name(vendors), "vendor_key", "left")
    return matched.withColumn("match_error", F.when(F.col("matched_vendor_id").isNull(), F.lit(UNMATCHED)))


def bulk_install(uploads: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per-file result: the first failing rule, else the match result."""
    checked = bulk_match(validate_readers(uploads).withColumnRenamed("error", "rule_error"), vendors)
    sound = F.col("rule_error").isNull()
    return checked.select(
        "file_name",
        F.when(sound, F.col("vendor_key")).alias("vendor_key"),
        F.when(sound, F.col("matched_vendor_id")).alias("matched_vendor_id"),
        (sound & F.col("match_error").isNull()).alias("ok"),
        F.coalesce("rule_error", "match_error").alias("error"),
    )


def bulk_result_class(results: DataFrame) -> DataFrame:
    unmatched = F.coalesce(F.col("error").startswith("unmatched"), F.lit(False))
    label = F.when(F.col("ok"), "submitted").when(unmatched, "pending").otherwise("overdue")
    return results.withColumn("result_class", label)


def bulk_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("ok").alias("ok_count"), F.count(F.lit(1)).alias("total"))


def bundled_readers(readers: DataFrame, vendors: DataFrame, installed: DataFrame) -> DataFrame:
    """Bundled files that pass the rules: does their vendor exist, are they installed?"""
    sound = validate_readers(readers.filter(F.col("file_name").endswith(READER_SUFFIX))).filter("ok")
    names = vendors.select(F.col("name").alias("vendor_key")).distinct().withColumn("vendor_exists", F.lit(True))
    present = installed_readers(installed).select("vendor_key", F.lit(True).alias("installed"))
    joined = sound.drop("installed_at").join(names, "vendor_key", "left").join(present, "vendor_key", "left")
    return joined.select(
        F.col("file_name"), "vendor_key", "version", "target_fields",
        F.coalesce("vendor_exists", F.lit(False)).alias("vendor_exists"),
        F.coalesce("installed", F.lit(False)).alias("installed"),
    )


def vendors_to_create(readers: DataFrame, vendors: DataFrame) -> DataFrame:
    """Names of sound bundled readers that have no vendor yet."""
    sound = validate_readers(readers.filter(F.col("file_name").endswith(READER_SUFFIX))).filter("ok")
    keys = sound.select(F.col("vendor_key").alias("name")).distinct()
    return keys.join(vendors.select("name"), "name", "left_anti")
