"""Who bought when, kept as a table: first and last purchase of every buyer without all history.

The state has one row per buyer and month: the first and the last day of a paid order in it, and
how many there were. A refresh rebuilds whole months from the orders of these months and replaces
them, so it may be repeated, takes late, moved and withdrawn orders, and reads no other day. First
purchases over all time are the least of a buyer's months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions import calendar as cal
from martwright.functions import values as v
from martwright.ranges import DateRange
from martwright.settings import Settings
from martwright.sources.core import CoreTables

BUYER_MONTHS = "buyer_months"
BUYER_MONTHS_DDL = "user_id string, first_date date, last_date date, paid_n bigint, month date"


def build_buyer_months(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Rows of all months that the range touches, each month as a whole. Orders without a user
    count as one buyer with a null id."""
    paid = core.events("orders").where(v.is_paid(cfg))
    return (
        cal.within(paid, "timestamp", rng.whole_months(), cfg.zone)
        .groupBy("user_id", F.trunc("date", "month").alias("month"))
        .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
             F.count("*").alias("paid_n"))
        .select("user_id", "first_date", "last_date", "paid_n", "month")
    )


def purchases(months: DataFrame) -> DataFrame:
    """(user_id, first_date, last_date, paid_n) over the months given; one row a buyer."""
    return months.groupBy("user_id").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.sum("paid_n").alias("paid_n"),
    )
