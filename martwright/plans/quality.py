"""Checks of the daily mart against the calendar, against itself and against the orders."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions import calendar as cal
from martwright.functions import values as v
from martwright.operators.frames import matching, one_row, top
from martwright.ranges import DateRange
from martwright.settings import Settings
from martwright.sources.core import CoreTables

ISSUES_SCHEMA = """
    issue_code string, severity string, message string, meta string,
    detected_at timestamp_ntz, resolved boolean"""

# Fixed values.
PROFIT_FLOOR = -1_000_000
MISSING_TEXT = "No analytics_daily_metrics row for date %s"
NEGATIVE_TEXT = "Suspicious values on %s: revenue=%s, profit=%s"
MISMATCH_TEXT = "Raw paid orders (%d) != analytics_daily_metrics paid (%d)"


def _issue(
    df: DataFrame, code: str, severity: str, message: Column, meta: Column, seen: dt.datetime
) -> DataFrame:
    return df.select(
        F.lit(code).alias("issue_code"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        F.to_json(meta).alias("meta"),
        cal.instant(seen).alias("detected_at"),
        F.lit(False).alias("resolved"),
    )


def missing_days(daily: DataFrame, rng: DateRange, seen: dt.datetime) -> DataFrame:
    present = daily.where(rng.holds(F.col("date"))).select("date")
    absent = rng.spine(daily.sparkSession).join(present, "date", "left_anti")
    text = F.col("date").cast("string")
    return _issue(
        absent.orderBy("date"),
        "missing_daily_row",
        "warning",
        F.format_string(MISSING_TEXT, text),
        F.struct(text.alias("date")),
        seen,
    )


def negative_values(daily: DataFrame, seen: dt.datetime, limit: int | None = None) -> DataFrame:
    """Looks at the whole mart, whatever the range, and reports every bad day, or the first
    ``limit``."""
    odd = daily.where((F.col("revenue_rub") < 0) | (F.col("profit_rub") < PROFIT_FLOOR))
    date = F.col("date").cast("string")
    revenue, profit = v.plain_decimal(F.col("revenue_rub")), v.plain_decimal(F.col("profit_rub"))
    return _issue(
        top(odd, limit, F.asc("date")),
        "negative_revenue_or_profit",
        "critical",
        F.format_string(NEGATIVE_TEXT, date, revenue, profit),
        F.struct(date.alias("date"), revenue.alias("revenue_rub"), profit.alias("profit_rub")),
        seen,
    )


def paid_mismatch(
    core: CoreTables, daily: DataFrame, rng: DateRange, cfg: Settings, seen: dt.datetime
) -> DataFrame:
    """One row when the paid orders of the range and the mart's paid counts differ."""
    raw = cal.within(core.events("orders").where(v.is_paid(cfg)), "timestamp", rng, cfg.zone).agg(
        F.count("*").alias("raw_paid")
    )
    booked = daily.where(rng.holds(F.col("date"))).agg(
        F.coalesce(F.sum("orders_paid_count"), F.lit(0)).alias("agg_paid")
    )
    raw_paid, agg_paid = F.col("raw_paid"), F.col("agg_paid")
    meta = F.struct(
        F.lit(str(rng.start)).alias("from"),
        F.lit(str(rng.end)).alias("to"),
        raw_paid,
        agg_paid,
        (raw_paid - agg_paid).alias("diff"),
    )
    return _issue(
        one_row(raw, booked).where(raw_paid != agg_paid),
        "paid_count_mismatch",
        "critical",
        F.format_string(MISMATCH_TEXT, raw_paid, agg_paid),
        meta,
        seen,
    )


def find_issues(
    core: CoreTables, daily: DataFrame, rng: DateRange, cfg: Settings, seen: dt.datetime
) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            missing_days(daily, rng, seen),
            negative_values(daily, seen),
            paid_mismatch(core, daily, rng, cfg, seen),
        ],
    )


def list_issues(issues: DataFrame, resolved: bool | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; all of them, or the first ``limit``."""
    kept = matching(issues, resolved=resolved)
    order = (F.desc("detected_at"), F.asc("issue_code"), F.asc("message"))
    return top(kept, limit, *order)


def issues_summary(issues: DataFrame) -> DataFrame:
    still_open = ~F.col("resolved")
    return issues.agg(
        F.count_if(still_open).alias("open_issues"),
        F.count_if(still_open & (F.col("severity") == "critical")).alias("critical_open_issues"),
    )
