"""Key figures, unusual days and the hourly load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions import calendar as cal
from martwright.functions import values as v
from martwright.operators.frames import one_row, top, z_scores
from martwright.plans.marts import Marts
from martwright.ranges import DAY, DateRange
from martwright.settings import Settings
from martwright.sources.core import CoreTables

SHORT_DAYS, LONG_DAYS = 7, 30
Z_THRESHOLD = 2.0


def _sum0(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _with_first_date(
    core: CoreTables, rng: DateRange, cfg: Settings, firsts: DataFrame | None
) -> DataFrame:
    """Paid orders by (user, day) with the day of the user's first purchase.

    Without ``firsts`` that is a window over the rows of all history; with it, orders before the
    range are not read. Nothing later than the last day that can count is.
    """
    last_day = rng.end + DAY * LONG_DAYS
    paid = core.events("orders").where(v.is_paid(cfg) & F.col("user_id").isNotNull())
    read = (
        cal.up_to(paid, "timestamp", last_day, cfg.zone) if firsts is None
        else cal.within(paid, "timestamp", DateRange(rng.start, last_day), cfg.zone)
    )
    days = read.groupBy("user_id", "date").agg(
        F.count("*").alias("orders"), v.sum_kopecks(F.col("amount_rub")).alias("kopecks")
    )
    if firsts is None:
        return days.withColumn("first_date", F.min("date").over(Window.partitionBy("user_id")))
    return days.join(firsts.select("user_id", "first_date"), "user_id")


def _buyer_history(
    core: CoreTables, rng: DateRange, cfg: Settings, firsts: DataFrame | None = None
) -> DataFrame:
    """One row of retention, early-value and repeat-revenue figures.

    Paid orders collapse to (user, day) before the first purchase is attached, and the grouping by
    user that follows uses the same partitioning.
    """
    date, first = F.col("date"), F.col("first_date")
    after, inside = date > first, rng.holds(date)
    early = date <= F.date_add(first, LONG_DAYS)
    per_user = (
        _with_first_date(core, rng, cfg, firsts)
        .groupBy("user_id", "first_date")
        .agg(
            F.max(F.when(after & (date <= F.date_add(first, SHORT_DAYS)), 1)).alias("short"),
            F.max(F.when(after & early, 1)).alias("long"),
            F.sum(F.when(early, F.col("orders"))).alias("early_orders"),
            F.sum(F.when(early, F.col("kopecks"))).alias("early_amount"),
            F.sum(F.when(inside, F.col("kopecks"))).alias("amount"),
            F.sum(F.when(inside & after, F.col("kopecks"))).alias("repeat_amount"),
        )
    )
    base = rng.holds(first)
    return per_user.agg(
        F.count_if(base).alias("users_in_base"),
        F.count_if(base & (F.col("short") == 1)).alias("retained_short"),
        F.count_if(base & (F.col("long") == 1)).alias("retained_long"),
        _sum0(F.when(base, F.col("early_orders"))).alias("early_orders"),
        v.from_kopecks(_sum0(F.when(base, F.col("early_amount")))).alias("early_amount"),
        v.from_kopecks(_sum0(F.col("amount"))).alias("live_amount"),
        v.from_kopecks(_sum0(F.col("repeat_amount"))).alias("repeat_amount"),
    )


def kpis(
    core: CoreTables, marts: Marts, rng: DateRange, cfg: Settings, firsts: DataFrame | None = None
) -> DataFrame:
    """One row of key figures. Early value is divided by early order rows, not by users.

    ``firsts``: (user_id, first_date) of all buyers, as ``plans.purchases`` keeps it; without it
    the orders of all history are read for it.
    """
    inside = rng.holds(F.col("date"))
    totals = marts.daily.where(inside).agg(
        _sum0(F.col("revenue_rub")).alias("revenue"),
        _sum0(F.col("profit_rub")).alias("profit"),
        _sum0(F.col("orders_paid_count")).alias("paid_orders_count"),
        _sum0(F.col("unique_buyers_count")).alias("buyers"),
        _sum0(F.col("repeat_buyers_count")).alias("repeat_buyers"),
    )
    discounts = marts.promo_daily.where(inside).agg(
        _sum0(F.col("discount_total_rub")).alias("discounts")
    )
    bonuses = marts.referral_daily.where(inside).agg(
        _sum0(F.col("referral_bonus_cost_rub")).alias("bonuses")
    )
    users, buyers = F.col("users_in_base"), F.col("buyers")
    acquisition = F.col("discounts") + F.col("bonuses")
    return one_row(totals, discounts, bonuses, _buyer_history(core, rng, cfg, firsts)).select(
        v.mean_money(F.col("revenue"), buyers).alias("arppu_rub"),
        v.rate(F.col("profit"), F.col("revenue")).alias("gross_margin_rate"),
        v.rate(F.col("retained_short"), users).alias("retention_d7_rate"),
        v.rate(F.col("retained_long"), users).alias("retention_d30_rate"),
        v.mean_money(F.col("early_amount"), F.col("early_orders")).alias("ltv_30d_proxy_rub"),
        v.mean_money(acquisition, users).alias("cac_proxy_rub"),
        v.rate(F.col("repeat_amount"), F.col("live_amount")).alias("repeat_revenue_share"),
        v.rate(F.col("repeat_buyers"), buyers).alias("repeat_buyer_rate"),
        "paid_orders_count",
        "users_in_base",
    )


def anomalies(marts: Marts, rng: DateRange, limit: int | None = None) -> DataFrame:
    """Days whose revenue or paid count lies two deviations or more from the range's mean: all,
    or the ``limit`` farthest."""
    scored = z_scores(
        marts.daily.where(rng.holds(F.col("date"))), ["revenue_rub", "orders_paid_count"]
    )
    kept = scored.where(F.abs("z") >= Z_THRESHOLD).select(
        "date",
        "metric",
        F.round("value", 2).alias("value"),
        F.round("z", 2).alias("z_score"),
    )
    return top(kept, limit, F.desc(F.abs("z_score")), F.asc("date"), F.asc("metric"))


def hourly_heatmap(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    local = cal.local_ts(F.col("timestamp"), cfg.zone)
    return (
        cal.within(core.events("orders").where(v.is_paid(cfg)), "timestamp", rng, cfg.zone)
        .groupBy(cal.iso_weekday(local).alias("iso_dow"), cal.hour_of(local).alias("hour"))
        .agg(
            F.count("*").alias("paid_orders_count"),
            F.coalesce(v.sum_money(F.col("amount_rub")), F.lit(0))
            .cast("double")
            .alias("revenue_rub"),
        )
        .orderBy("iso_dow", "hour")
    )


def insights(
    core: CoreTables, marts: Marts, rng: DateRange, cfg: Settings
) -> dict[str, DataFrame]:
    return {
        "kpis": kpis(core, marts, rng, cfg),
        "anomalies": anomalies(marts, rng),
        "hourly_heatmap": hourly_heatmap(core, rng, cfg),
    }
