"""The monthly submission grid of every project."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import REAL_PERIOD, deadline_day, local_now, month_number, period_text
from ..sources.lists import settlement_day


def project_months(projects: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """First and last due month of each project as month numbers.

    The base is the start date, else the creation date, else now. Projects that start
    after the current month have no due month.
    """
    now = local_now(as_of)
    base = F.coalesce(F.to_date("start_date"), F.to_date("created_at"), F.lit(now.date()))
    last = F.lit(now.year * 12 + now.month - 1)
    first = projects.select(F.col("id").alias("project_id"), month_number(base).alias("first_month"))
    return first.filter(F.col("first_month") <= last).select("project_id", "first_month", last.alias("last_month"))


def period_spine(projects: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """One row per project and due month."""
    months = project_months(projects, as_of)
    month = F.explode(F.sequence("first_month", "last_month")).alias("month")
    return months.select("project_id", month).select("project_id", period_text(F.col("month")).alias("period"))


def submitted_months(ledger: DataFrame) -> DataFrame:
    """(project_id, month) of monthly records, repeats included. Periods that are no month drop out."""
    monthly = ledger.filter((F.col("type") == "monthly") & F.col("period").rlike(REAL_PERIOD))
    year, month = F.substring("period", 1, 4).cast("int"), F.substring("period", 6, 2).cast("int")
    return monthly.select("project_id", (year * 12 + month - 1).alias("month"))


def submission_status(
    projects: DataFrame, ledger: DataFrame, settings: DataFrame, as_of: datetime | str | None = None
) -> DataFrame:
    """submitted, overdue or pending for each due month of each project.

    Due months and submitted months meet in one aggregate by (project, month) instead of
    a join: one shuffle of fixed-width rows, combined before it, so a project with a
    third of all records costs no more than its months. A month turns overdue at 00:00
    Taipei time on its deadline.
    """
    now = local_now(as_of)
    day = settlement_day(settings).select(deadline_day("settlement_day")).scalar()
    spans = project_months(projects, as_of)
    due = spans.select("project_id", F.explode(F.sequence("first_month", "last_month")).alias("month"))
    seen = due.withColumns({"due": F.lit(1), "done": F.lit(0)}).unionByName(
        submitted_months(ledger).withColumns({"due": F.lit(0), "done": F.lit(1)})
    )
    grid = seen.groupBy("project_id", "month").agg(F.max("due").alias("due"), F.max("done").alias("done"))
    periods = grid.filter("due = 1").select("project_id", period_text(F.col("month")).alias("period"), "done")
    dated = periods.withColumn("deadline", F.concat("period", F.lit("-"), day))
    status = (
        F.when(F.col("done") == 1, "submitted")
        .when(F.col("deadline") <= F.lit(now.date().isoformat()), "overdue")
        .otherwise("pending")
    )
    return dated.select("project_id", "period", "deadline", status.alias("status"))
