"""Metric queries over the marts, and the day and user drill-downs over the core tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions import calendar as cal
from martwright.functions import values as v
from martwright.operators.frames import (
    attach_names,
    fill_days,
    matching,
    one_row,
    reduced,
    top,
)
from martwright.operators.grams import SearchIndex, any_like
from martwright.plans.marts import Marts
from martwright.ranges import DateRange, cohort_window
from martwright.settings import Settings
from martwright.sources.core import CoreTables


# --- mart reads ----------------------------------------------------------------------------


def daily(marts: Marts, rng: DateRange) -> DataFrame:
    return marts.daily.where(rng.holds(F.col("date"))).orderBy("date")


def providers(marts: Marts, rng: DateRange) -> DataFrame:
    kept = marts.provider_daily.where(rng.holds(F.col("date")))
    return kept.orderBy("date", "payment_provider")


def products(marts: Marts, rng: DateRange) -> DataFrame:
    kept = marts.product_daily.where(rng.holds(F.col("date")))
    return kept.orderBy("date", "product_type")


def promos(marts: Marts, rng: DateRange, promo_code: str | None = None) -> DataFrame:
    kept = marts.promo_daily.where(rng.holds(F.col("date")))
    return matching(kept, promo_code=promo_code).orderBy("date", "promo_code")


def default_cohort_range(as_of: dt.date) -> DateRange:
    """Cohort weeks listed when none are asked for."""
    return cohort_window(as_of).weeks()


def cohorts(marts: Marts, weeks: DateRange, age_week: int | None = None) -> DataFrame:
    kept = marts.cohort_weekly.where(weeks.holds(F.col("cohort_week")))
    return matching(kept, age_week=age_week).orderBy("cohort_week", "age_week")


# --- summary -------------------------------------------------------------------------------


def _largest(df: DataFrame, rng: DateRange, label: str) -> DataFrame:
    sums = (
        df.where(rng.holds(F.col("date")))
        .groupBy(label)
        .agg(F.sum("revenue_rub").cast("decimal(24,2)").alias("total_revenue"))
    )
    return top(sums, 1, F.desc("total_revenue"), F.asc(label))


def top_provider(marts: Marts, rng: DateRange) -> DataFrame:
    return _largest(marts.provider_daily, rng, "payment_provider")


def top_product(marts: Marts, rng: DateRange) -> DataFrame:
    return _largest(marts.product_daily, rng, "product_type")


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def summary(marts: Marts, rng: DateRange) -> DataFrame:
    """One row of totals. Buyer counts are sums of daily counts, so a buyer counts once a day."""
    sums = marts.daily.where(rng.holds(F.col("date"))).agg(
        _total("orders_created_count"),
        _total("orders_paid_count"),
        _total("revenue_rub"),
        _total("profit_rub"),
        _total("unique_buyers_count"),
        _total("repeat_buyers_count"),
    )
    best_provider = top_provider(marts, rng).select(
        F.col("payment_provider").alias("top_provider"),
        F.col("total_revenue").cast("double").alias("top_provider_revenue_rub"),
    )
    best_product = top_product(marts, rng).select(
        F.col("product_type").alias("top_product"),
        F.col("total_revenue").cast("double").alias("top_product_revenue_rub"),
    )
    created, paid = F.col("orders_created_count"), F.col("orders_paid_count")
    buyers, repeat = F.col("unique_buyers_count"), F.col("repeat_buyers_count")
    return one_row(sums, best_provider, best_product).select(
        F.lit(rng.start).alias("from"),
        F.lit(rng.end).alias("to"),
        created,
        paid,
        v.rate(paid, created).alias("paid_conversion_rate"),
        F.round(F.col("revenue_rub").cast("double"), 2).alias("revenue_total_rub"),
        F.round(F.col("profit_rub").cast("double"), 2).alias("profit_total_rub"),
        v.mean_money(F.col("revenue_rub"), paid).alias("avg_check_rub"),
        buyers,
        repeat,
        v.rate(repeat, buyers).alias("repeat_purchase_rate"),
        "top_provider",
        F.round("top_provider_revenue_rub", 2).alias("top_provider_revenue_rub"),
        "top_product",
        F.round("top_product_revenue_rub", 2).alias("top_product_revenue_rub"),
    )


# --- one day -------------------------------------------------------------------------------


def _paid_sum(cfg: Settings, value: Column) -> Column:
    total = v.sum_money(F.when(v.is_paid(cfg), value))
    return F.coalesce(total, F.lit(0)).cast("double")


def day_breakdown(core: CoreTables, marts: Marts, day: dt.date, cfg: Settings) -> DataFrame:
    """Money of one day: revenue less cost, promo discounts and referral bonuses."""
    rng = DateRange.one_day(day)
    sales = cal.within(core.events("orders"), "timestamp", rng, cfg.zone).agg(
        F.count("*").alias("orders_created_count"),
        F.count_if(v.is_paid(cfg)).alias("orders_paid_count"),
        _paid_sum(cfg, F.col("amount_rub")).alias("revenue"),
        _paid_sum(cfg, v.effective_cost(cfg)).alias("cost"),
    )
    discount = marts.promo_daily.where(F.col("date") == F.lit(day)).agg(
        F.coalesce(F.sum("discount_total_rub"), F.lit(0)).cast("double").alias("discount")
    )
    bonus = marts.referral_daily.where(F.col("date") == F.lit(day)).agg(
        F.coalesce(F.max("referral_bonus_cost_rub"), F.lit(0)).cast("double").alias("bonus")
    )
    revenue, cost = F.col("revenue"), F.col("cost")
    net = revenue - cost - F.col("discount") - F.col("bonus")
    return one_row(sales, discount, bonus).select(
        F.lit(day).alias("date"),
        "orders_created_count",
        "orders_paid_count",
        F.round(revenue, 2).alias("revenue_rub"),
        F.round(cost, 2).alias("cost_rub"),
        F.round(revenue - cost, 2).alias("gross_profit_rub"),
        F.round("discount", 2).alias("promo_discount_rub"),
        F.round("bonus", 2).alias("referral_bonus_rub"),
        F.round(net, 2).alias("net_profit_estimate_rub"),
        F.round(revenue, 2).alias("turnover_rub"),
    )


def day_buyers(core: CoreTables, day: dt.date, cfg: Settings) -> DataFrame:
    """Users with a paid order that day. Orders collapse to one row per user before the names
    are looked up; NULL users stay one unnamed row."""
    bought = (
        cal.within(
            core.events("orders").where(v.is_paid(cfg)), "timestamp", DateRange.one_day(day), cfg.zone
        )
        .groupBy("user_id")
        .agg(
            F.count("*").alias("paid_orders_count"),
            _paid_sum(cfg, F.col("amount_rub")).alias("revenue_rub"),
            _paid_sum(cfg, v.effective_cost(cfg)).alias("cost_rub"),
            _paid_sum(cfg, v.gross_profit(cfg)).alias("gross_profit_rub"),
        )
    )
    # The day's plain ids cut the users down before they are shuffled.
    ids = cal.within(
        core.events("orders").where(v.is_paid(cfg)), "timestamp", DateRange.one_day(day), cfg.zone
    ).select("user_id")
    names = core.events("users").select("user_id", "username").join(ids, "user_id", "left_semi")
    return (
        bought.join(names, "user_id", "left")
        .select(
            "user_id",
            v.or_dash(F.col("username")).alias("username"),
            "paid_orders_count",
            "revenue_rub",
            "cost_rub",
            "gross_profit_rub",
        )
        .orderBy(F.desc("revenue_rub"), F.asc("user_id"))
    )


def _order_line(cfg: Settings) -> list[Column]:
    return [
        v.or_unknown(F.col("payment_provider")).alias("payment_provider"),
        F.coalesce(F.col("amount_rub"), F.lit(0)).cast("double").alias("amount_rub"),
        v.effective_cost(cfg).cast("double").alias("cost_rub"),
        v.null_to_dash(F.col("promo_code")).alias("promo_code"),
        cal.local_ts(F.col("timestamp"), cfg.zone).alias("timestamp_msk"),
    ]


def day_orders(
    core: CoreTables, day: dt.date, cfg: Settings, limit: int | None = None
) -> DataFrame:
    """Orders of the day, newest first; a list of the latest ``limit`` is cut before names are
    attached."""
    orders = cal.within(core.events("orders"), "timestamp", DateRange.one_day(day), cfg.zone)
    latest = top(orders, limit, F.desc("timestamp"), F.asc("order_id")).select(
        "order_id", "user_id", "status", "product_type", *_order_line(cfg)
    )
    return (
        attach_names(latest, core.events("users"), "user_id", ["username"], limit)
        .select(
            "order_id",
            "user_id",
            v.or_dash(F.col("username")).alias("username"),
            "status",
            "product_type",
            "payment_provider",
            "amount_rub",
            "cost_rub",
            "promo_code",
            "timestamp_msk",
        )
        .orderBy(F.desc("timestamp_msk"), F.asc("order_id"))
    )


def day_details(
    core: CoreTables, marts: Marts, day: dt.date, cfg: Settings
) -> dict[str, DataFrame]:
    return {
        "breakdown": day_breakdown(core, marts, day, cfg),
        "buyers": day_buyers(core, day, cfg),
        "orders": day_orders(core, day, cfg),
    }


# --- users ---------------------------------------------------------------------------------


def _profile_columns(cfg: Settings) -> list[Column]:
    return [
        F.col("user_id"),
        v.or_dash(F.col("username")).alias("username"),
        v.or_dash(F.col("referrer_id")).alias("referrer_id"),
        cal.local_date(F.col("created_at"), cfg.zone).alias("user_created_date"),
    ]


SEARCHED = ("user_id", "username")


def index_users(core: CoreTables, folder: str, **settings) -> SearchIndex:
    """A search index of all users in a new folder; to be built anew as users change."""
    return SearchIndex.build(core.events("users"), "user_id", SEARCHED, folder, **settings)


def users(
    core: CoreTables,
    rng: DateRange,
    cfg: Settings,
    search: str | None = None,
    limit: int | None = None,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Users by in-range revenue. First and last paid dates span all history.

    Orders collapse to one row per user first; profile columns never pass through the grouping.
    ``%`` and ``_`` in the search text act as wildcards, a backslash as itself. Of a search only
    the orders of the users found are grouped. All users are listed, or the first ``limit``.
    With an ``index`` of the users (:func:`index_users`) a search reads no other users than its.
    """
    found = core.events("users")
    wanted = (search or "").strip()
    if wanted:
        pattern = "%" + wanted.replace("\\", "\\\\") + "%"
        if index is not None:
            found = index.find(pattern)
        else:
            found = found.where(any_like(SEARCHED, pattern))
    date = F.col("date")
    inside, paid = rng.holds(date), v.is_paid(cfg)
    has_id = F.col("order_id").isNotNull()
    orders = core.events("orders").where(F.col("user_id").isNotNull())
    if wanted:
        orders = orders.join(found.select("user_id"), "user_id", "left_semi")
    per_user = (
        orders
        .withColumn("date", cal.local_date(F.col("timestamp"), cfg.zone))
        .groupBy("user_id")
        .agg(
            F.count_if(inside & has_id).alias("created"),
            F.count_if(inside & paid & has_id).alias("paid"),
            v.sum_money(F.when(inside & paid, F.col("amount_rub"))).alias("revenue"),
            v.sum_money(F.when(inside & paid, v.gross_profit(cfg))).alias("gross"),
            F.min(F.when(paid, date)).alias("first_paid_date"),
            F.max(F.when(paid, date)).alias("last_paid_date"),
        )
    )
    listed = found.join(per_user, "user_id", "left").select(
        *_profile_columns(cfg),
        v.zero(F.col("created")).alias("orders_created_count"),
        v.zero(F.col("paid")).alias("orders_paid_count"),
        v.zero(F.col("revenue")).cast("double").alias("revenue_rub"),
        v.zero(F.col("gross")).cast("double").alias("gross_profit_rub"),
        "first_paid_date",
        "last_paid_date",
    )
    order = (F.desc("revenue_rub"), F.desc("orders_paid_count"), F.asc("user_id"))
    return top(listed, limit, *order)


def user_profile(core: CoreTables, user_id: str, cfg: Settings) -> DataFrame:
    return core.events("users").where(F.col("user_id") == F.lit(user_id)).select(*_profile_columns(cfg))


def _orders_of(core: CoreTables, user_id: str, rng: DateRange, cfg: Settings) -> DataFrame:
    own = core.events("orders").where(F.col("user_id") == F.lit(user_id))
    return cal.within(own, "timestamp", rng, cfg.zone)


def user_summary(core: CoreTables, user_id: str, rng: DateRange, cfg: Settings) -> DataFrame:
    return _orders_of(core, user_id, rng, cfg).agg(
        F.count("*").alias("orders_created_count"),
        F.count_if(v.is_paid(cfg)).alias("orders_paid_count"),
        _paid_sum(cfg, F.col("amount_rub")).alias("revenue_rub"),
        _paid_sum(cfg, v.gross_profit(cfg)).alias("gross_profit_rub"),
    )


def user_orders(
    core: CoreTables, user_id: str, rng: DateRange, cfg: Settings, limit: int | None = None
) -> DataFrame:
    own = _orders_of(core, user_id, rng, cfg)
    return top(own, limit, F.desc("timestamp"), F.asc("order_id")).select(
        "order_id", "status", "product_type", *_order_line(cfg)
    )


def user_details(
    core: CoreTables, user_id: str, rng: DateRange, cfg: Settings
) -> dict[str, DataFrame]:
    if not (user_id or "").strip():
        raise ValueError("user_id is required")
    profile = user_profile(core, user_id, cfg)
    if profile.isEmpty():
        raise LookupError("User not found")
    return {
        "profile": profile,
        "summary": user_summary(core, user_id, rng, cfg),
        "orders": user_orders(core, user_id, rng, cfg),
    }


# --- funnel --------------------------------------------------------------------------------


def funnel(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Stand-in funnel by day: distinct ordering users, orders, orders with a payment event.

    Payment events of all history are first reduced to the range's orders where they are scanned,
    so what is shuffled grows with the range. They collapse to distinct order ids before the join,
    so an order with any number of events is one row there; orders then collapse to (day, user).
    """
    orders = cal.within(core.events("orders"), "timestamp", rng, cfg.zone)
    paying = core.events("payment_transactions").where(F.col("order_id").isNotNull())
    with_payment = (
        reduced(paying.select("order_id"), "order_id", orders)
        .distinct()
        .withColumn("checked_out", F.lit(1))
    )
    by_day = (
        orders.join(with_payment, "order_id", "left")
        .groupBy("date", "user_id")
        .agg(
            F.count("*").alias("created"),
            F.count_if(v.is_paid(cfg)).alias("paid"),
            F.count("checked_out").alias("checkout"),
        )
        .groupBy("date")
        .agg(
            F.count("user_id").alias("users"),
            F.sum("created").alias("created"),
            F.sum("paid").alias("paid"),
            F.sum("checkout").alias("checkout"),
        )
    )
    created, checkout, paid = F.col("created"), F.col("checkout"), F.col("paid")
    started = v.rate(checkout, created)
    return (
        fill_days(core.spark, rng, by_day)
        .select(
            "date",
            v.zero(F.col("users")).alias("app_open_count"),
            v.zero(created).alias("product_view_count"),
            v.zero(checkout).alias("checkout_start_count"),
            v.zero(created).alias("order_created_count"),
            v.zero(paid).alias("order_paid_count"),
            started.alias("open_to_checkout_rate"),
            started.alias("checkout_to_created_rate"),
            v.rate(paid, created).alias("created_to_paid_rate"),
        )
        .orderBy("date")
    )
