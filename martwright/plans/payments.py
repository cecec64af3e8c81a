"""Payment attempts by day, by provider and by failure reason; referral traffic by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions import calendar as cal
from martwright.functions import values as v
from martwright.functions.attempts import attempt_key, is_success, provider_name
from martwright.operators.frames import fill_days, reduced, top
from martwright.plans.marts import (
    Marts,
    referred_ids,
    referred_signups,
    sales_totals,
)
from martwright.ranges import DateRange
from martwright.settings import Settings
from martwright.sources.core import CoreTables



def _undated(core: CoreTables) -> DataFrame:
    """Transactions that take their day from their order."""
    tx = core.events("payment_transactions")
    missing = F.col("created_at").isNull() & F.col("order_id").isNotNull()
    if "created_at_day" in tx.columns:
        missing = missing & F.col("created_at_day").isNull()
    return tx.where(missing)


def _order_dates(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    return cal.within(core.events("orders"), "timestamp", rng, cfg.zone).select("order_id", "date")


def payment_events(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Transactions of the range: (date, provider, status, tx_key, success, events = 1).

    Only a transaction without a time of its own needs its order, so only those are joined; the
    rest, rows without an order among them, never reach that shuffle. A row with neither a time
    nor an order has no day and is outside every range. What is left of a heavy order in the
    join is split by the run-time skew handling.
    """
    columns = [
        F.col("date"),
        provider_name(cfg).alias("provider"),
        v.or_unknown(F.col("status")).alias("status"),
        attempt_key(cfg).alias("tx_key"),
        is_success(cfg).alias("success"),
        F.lit(1).alias("events"),
    ]
    dated = cal.within(core.events("payment_transactions"), "created_at", rng, cfg.zone)
    by_order = _undated(core).join(_order_dates(core, rng, cfg), "order_id")
    return dated.select(*columns).unionByName(by_order.select(*columns))


def attempt_grain(events: DataFrame) -> DataFrame:
    """Events collapsed to what all three payment views need; same columns as the events."""
    return events.groupBy("date", "provider", "status", "tx_key").agg(
        F.max("success").alias("success"), F.sum("events").alias("events")
    )


def _attempts(events: DataFrame, key: str) -> DataFrame:
    """Attempt outcomes by ``key``: one attempt per (key, tx_key), successful if any event was."""
    return (
        events.groupBy(key, "tx_key")
        .agg(F.max("success").alias("success"), F.sum("events").alias("events"))
        .groupBy(key)
        .agg(
            F.count("*").alias("payment_attempts_count"),
            F.count_if(F.col("success") == 1).alias("payment_success_count"),
            F.count_if(F.col("success") == 0).alias("payment_failed_count"),
            F.sum("events").alias("payment_events_count"),
        )
    )


ATTEMPT_COUNTS = (
    "payment_attempts_count",
    "payment_success_count",
    "payment_failed_count",
    "payment_events_count",
)


def _zeroed(*names: str) -> list:
    return [v.zero(F.col(n)).alias(n) for n in names]


def payments_daily(
    core: CoreTables, rng: DateRange, cfg: Settings, events: DataFrame | None = None
) -> DataFrame:
    events = payment_events(core, rng, cfg) if events is None else events
    filled = fill_days(
        core.spark, rng, sales_totals(core.events("orders"), rng, cfg), _attempts(events, "date")
    )
    return filled.select(
        "date",
        v.zero(F.col("created_n")).alias("orders_created_count"),
        v.zero(F.col("paid_n")).alias("orders_paid_count"),
        v.zero(F.col("failed_n")).alias("orders_failed_count"),
        v.money_or_zero(F.col("amount")).cast("double").alias("revenue_rub"),
        *_zeroed(*ATTEMPT_COUNTS),
    ).orderBy("date")


def payments_providers(
    core: CoreTables, rng: DateRange, cfg: Settings, events: DataFrame | None = None
) -> DataFrame:
    """Orders beside attempts by provider. Aliases are folded on the attempt side only."""
    events = payment_events(core, rng, cfg) if events is None else events
    orders = (
        cal.within(core.events("orders"), "timestamp", rng, cfg.zone)
        .groupBy(v.or_unknown(F.col("payment_provider")).alias("provider"))
        .agg(
            F.count("*").alias("orders_created_count"),
            F.count_if(v.is_paid(cfg)).alias("orders_paid_count"),
            v.sum_money(F.when(v.is_paid(cfg), F.col("amount_rub"))).alias("amount"),
        )
    )
    return (
        orders.join(_attempts(events, "provider"), "provider", "full_outer")
        .select(
            "provider",
            *_zeroed("orders_created_count", "orders_paid_count"),
            v.money_or_zero(F.col("amount")).cast("double").alias("revenue_rub"),
            *_zeroed(*ATTEMPT_COUNTS),
        )
        .orderBy(F.desc("revenue_rub"), F.desc("payment_attempts_count"), F.asc("provider"))
    )


def payment_failures(
    core: CoreTables, rng: DateRange, cfg: Settings, events: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Attempts that never succeeded, by provider and status, most frequent first: all, or the
    first ``limit``.

    Events collapse to one row per (attempt, status); an attempt's outcome is then a window over
    its few statuses, and counting the rows counts the attempts.
    """
    events = payment_events(core, rng, cfg) if events is None else events
    outcome = F.max("success").over(Window.partitionBy("provider", "tx_key"))
    failed = (
        events.groupBy("provider", "tx_key", "status")
        .agg(F.max("success").alias("success"))
        .withColumn("outcome", outcome)
        .where(F.col("outcome") == 0)
        .groupBy("provider", "status")
        .agg(F.count("*").alias("failures_count"))
    )
    return top(
        failed, limit, F.desc("failures_count"), F.asc("provider"), F.asc("status")
    )


def payments_summary(daily: DataFrame) -> DataFrame:
    """Totals of :func:`payments_daily` and the two success rates."""
    counts = [
        "orders_created_count",
        "orders_paid_count",
        "orders_failed_count",
        *ATTEMPT_COUNTS,
    ]
    totals = daily.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.coalesce(F.sum(v.money(F.col("revenue_rub"))), F.lit(0)).alias("revenue_rub"),
    )
    return totals.select(
        *counts,
        F.round(F.col("revenue_rub").cast("double"), 2).alias("revenue_rub"),
        v.rate(F.col("payment_success_count"), F.col("payment_attempts_count")).alias(
            "payment_success_rate"
        ),
        v.rate(F.col("orders_paid_count"), F.col("orders_created_count")).alias("paid_order_rate"),
    )


def payments(
    core: CoreTables,
    rng: DateRange,
    cfg: Settings,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """All payment views over one attempt grain.

    Pass ``keep=materialize`` when several parts will be read, so that the transactions are
    scanned once.
    """
    events = keep(attempt_grain(payment_events(core, rng, cfg)))
    daily = payments_daily(core, rng, cfg, events)
    return {
        "summary": payments_summary(daily),
        "daily": daily,
        "providers": payments_providers(core, rng, cfg, events),
        "failure_reasons": payment_failures(core, rng, cfg, events),
    }


# --- referrals -----------------------------------------------------------------------------


def _referred_orders(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Orders of referred users by day, collapsed to (day, user) before the users are joined."""
    paid = v.is_paid(cfg)
    return (
        cal.within(core.events("orders").where(F.col("user_id").isNotNull()), "timestamp", rng, cfg.zone)
        .groupBy("date", "user_id")
        .agg(
            F.count("*").alias("created"),
            F.count_if(paid).alias("paid"),
            F.count_if(v.is_failed(cfg)).alias("failed"),
            v.sum_kopecks(F.when(paid, F.col("amount_rub"))).alias("kopecks"),
        )
        .join(referred_ids(core), "user_id")
        .groupBy("date")
        .agg(
            F.sum("created").alias("referred_orders_created_count"),
            F.sum("paid").alias("referred_orders_paid_count"),
            F.sum("failed").alias("referred_orders_failed_count"),
            F.count_if(F.col("paid") > 0).alias("referred_unique_buyers_count"),
            v.money(v.from_kopecks(F.sum("kopecks"))).alias("referred_revenue_rub"),
        )
    )


def _referred_transactions(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Payment events and distinct paying orders of referred users by day.

    Orders of all history are reduced to those of the range's events where they are scanned, and
    events without a time to the range's orders, so what is shuffled grows with the range.
    Events collapse to (order, day) before the orders are joined, and then to (day, user) before
    the users are, so neither a heavy order nor a heavy user reaches a join as more than one row
    per day. Grouping by order rides on the join's own partitioning.
    """
    tx = core.events("payment_transactions").where(F.col("order_id").isNotNull())
    placed = core.events("orders").where(F.col("user_id").isNotNull())
    dated = cal.within(tx, "created_at", rng, cfg.zone)
    own = dated.groupBy("order_id", "date").agg(F.count("*").alias("events"))
    owners = reduced(placed.select("order_id", "user_id"), "order_id", dated)
    in_range = cal.within(placed, "timestamp", rng, cfg.zone).select("order_id", "user_id", "date")
    undated = reduced(_undated(core).select("order_id"), "order_id", in_range)
    borrowed = undated.groupBy("order_id").agg(F.count("*").alias("events"))
    return (
        own.join(owners, "order_id")
        .unionByName(borrowed.join(in_range, "order_id"))
        .groupBy("date", "order_id", "user_id")
        .agg(F.sum("events").alias("events"))
        .groupBy("date", "user_id")
        .agg(F.sum("events").alias("events"), F.count("*").alias("orders"))
        .join(referred_ids(core), "user_id")
        .groupBy("date")
        .agg(
            F.sum("events").alias("referred_payment_attempts_count"),
            F.sum("orders").alias("referred_payment_orders_count"),
        )
    )


REFERRAL_COUNTS = (
    "new_referred_users_count",
    "referred_orders_created_count",
    "referred_orders_paid_count",
    "referred_orders_failed_count",
    "referred_payment_attempts_count",
    "referred_payment_orders_count",
    "referred_unique_buyers_count",
)
REFERRAL_MONEY = ("referred_revenue_rub", "referral_bonus_cost_rub", "referral_profit_rub")


def referrals(core: CoreTables, marts: Marts, rng: DateRange, cfg: Settings) -> DataFrame:
    """Referral traffic by day: live counts, with bonus and profit from the referral mart."""
    booked = marts.referral_daily.where(rng.holds(F.col("date"))).select(
        "date", "referral_bonus_cost_rub", "referral_profit_rub"
    )
    filled = fill_days(
        core.spark,
        rng,
        referred_signups(core, rng, cfg),
        _referred_orders(core, rng, cfg),
        _referred_transactions(core, rng, cfg),
        booked,
    )
    created, paid = F.col("referred_orders_created_count"), F.col("referred_orders_paid_count")
    attempts = F.col("referred_payment_attempts_count")
    revenue, bonus = F.col("referred_revenue_rub"), F.col("referral_bonus_cost_rub")
    return (
        filled.select(
            "date",
            *_zeroed(*REFERRAL_COUNTS),
            *[v.money_or_zero(F.col(m)).cast("double").alias(m) for m in REFERRAL_MONEY],
        )
        .withColumns(
            {
                "referred_created_to_paid_rate": v.rate(paid, created),
                "referred_attempt_to_paid_rate": v.rate(paid, attempts),
                "referred_avg_check_rub": v.mean_money(revenue, paid),
                "referral_net_after_bonus_rub": F.round(revenue - bonus, 2),
                "referral_profit_margin_rate": v.rate(F.col("referral_profit_rub"), revenue),
            }
        )
        .orderBy("date")
    )


def referrals_totals(items: DataFrame) -> DataFrame:
    totals = items.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in REFERRAL_COUNTS],
        *[F.coalesce(F.sum(v.money(F.col(m))), F.lit(0)).alias(m) for m in REFERRAL_MONEY],
    )
    paid = F.col("referred_orders_paid_count")
    return totals.select(
        *REFERRAL_COUNTS,
        *[F.round(F.col(m).cast("double"), 2).alias(m) for m in REFERRAL_MONEY],
        v.rate(paid, F.col("referred_orders_created_count")).alias("referred_created_to_paid_rate"),
        v.rate(paid, F.col("referred_payment_attempts_count")).alias(
            "referred_attempt_to_paid_rate"
        ),
    )
