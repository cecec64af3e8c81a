"""Builders of the six marts. Each returns the mart's key and measures, without audit columns.

Shape shared by all: scan only the needed columns and days, aggregate on the map side down to
days x labels (or users x days), and join nothing but the aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions import calendar as cal
from martwright.functions import values as v
from martwright.operators.frames import fill_days, running_sum
from martwright.ranges import DAY, DateRange
from martwright.settings import Settings
from martwright.sources.core import CoreTables

COHORT_AGES = 13  # ages 0..12


@dataclass(frozen=True)
class MartSpec:
    keys: tuple[str, ...]
    ddl: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def period(self) -> str:
        """Key column that holds the day or week."""
        return self.keys[0]


COUNT, MONEY, RATE = "bigint", v.MONEY, v.RATE

MARTS = {
    "daily": MartSpec(
        ("date",),
        f"""date date, orders_created_count {COUNT}, orders_paid_count {COUNT},
        orders_failed_count {COUNT}, orders_cancelled_count {COUNT}, revenue_rub {MONEY},
        cost_rub {MONEY}, profit_rub {MONEY}, avg_check_rub {MONEY}, pay_conversion_rate {RATE},
        unique_buyers_count {COUNT}, repeat_buyers_count {COUNT}""",
    ),
    "provider_daily": MartSpec(
        ("date", "payment_provider"),
        f"""date date, payment_provider string, orders_created_count {COUNT},
        orders_paid_count {COUNT}, revenue_rub {MONEY}, cost_rub {MONEY}, profit_rub {MONEY},
        avg_check_rub {MONEY}, paid_conversion_rate {RATE}""",
    ),
    "product_daily": MartSpec(
        ("date", "product_type"),
        f"""date date, product_type string, orders_paid_count {COUNT}, revenue_rub {MONEY},
        cost_rub {MONEY}, profit_rub {MONEY}, avg_check_rub {MONEY}""",
    ),
    "referral_daily": MartSpec(
        ("date",),
        f"""date date, new_referred_users_count {COUNT}, referred_buyers_count {COUNT},
        referred_orders_paid_count {COUNT}, referred_revenue_rub {MONEY},
        referral_bonus_cost_rub {MONEY}, referral_profit_rub {MONEY}""",
    ),
    "promo_daily": MartSpec(
        ("date", "promo_code"),
        f"""date date, promo_code string, redemptions_count {COUNT}, paid_orders_count {COUNT},
        discount_total_rub {MONEY}, revenue_after_discount_rub {MONEY},
        profit_after_discount_rub {MONEY}""",
    ),
    "cohort_weekly": MartSpec(
        ("cohort_week", "age_week"),
        f"""cohort_week date, age_week int, users_count {COUNT}, repeat_buyers_count {COUNT},
        retention_rate {RATE}, period_revenue_rub {MONEY}, cumulative_revenue_rub {MONEY}""",
    ),
}


def shaped(name: str, df: DataFrame) -> DataFrame:
    """Columns of the mart in order and in their stored types; missing numbers become 0."""
    spec = MARTS[name]
    out = []
    for field in spec.schema:
        kind = field.dataType.simpleString()
        cast = f"CAST({field.name} AS {kind})"
        if field.name not in spec.keys:
            cast = f"coalesce({cast}, CAST(0 AS {kind}))"
        out.append(f"{cast} AS {field.name}")
    return df.selectExpr(*out)


# --- shared grains -------------------------------------------------------------------------


def sales_totals(
    orders: DataFrame, rng: DateRange, cfg: Settings, labels: tuple[str, ...] = ()
) -> DataFrame:
    """Additive order measures by local day and the given labels.

    Everything is a sum or a count, so it collapses before the shuffle and can be rolled up again.
    """
    paid = v.is_paid(cfg)
    amount = F.when(paid, F.col("amount_rub"))
    named = {
        "payment_provider": v.or_unknown(F.col("payment_provider")),
        "product_type": v.or_unknown(F.col("product_type")),
    }
    return (
        cal.within(orders, "timestamp", rng, cfg.zone)
        .groupBy("date", *[named[label].alias(label) for label in labels])
        .agg(
            F.count("*").alias("created_n"),
            F.count_if(paid).alias("paid_n"),
            F.count_if(v.is_failed(cfg)).alias("failed_n"),
            F.count(amount).alias("amount_n"),
            v.sum_money(amount).alias("amount"),
            v.sum_money(F.when(paid, v.effective_cost(cfg))).alias("cost"),
            v.sum_money(F.when(paid, v.effective_profit(cfg))).alias("profit"),
        )
    )


def _rolled_up(totals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    measures = [c for c in totals.columns if c.endswith("_n")] + ["amount", "cost", "profit"]
    return totals.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def sales_mix(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Grain that daily, provider and product marts all roll up from: one scan for the three."""
    return sales_totals(core.events("orders"), rng, cfg, ("payment_provider", "product_type"))


def buyer_days(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Paid orders by (day, user): grain of every buyer count.

    A buyer with any share of the orders is one row per day from here on. NULL users form a group.
    """
    return (
        cal.within(core.events("orders").where(v.is_paid(cfg)), "timestamp", rng, cfg.zone)
        .groupBy("date", "user_id")
        .agg(
            F.count("*").alias("paid_n"),
            v.sum_kopecks(F.col("amount_rub")).alias("kopecks"),
            v.sum_kopecks(v.effective_profit(cfg)).alias("profit_kopecks"),
        )
    )


def _sales_columns() -> dict:
    return {
        "orders_created_count": F.col("created_n"),
        "orders_paid_count": F.col("paid_n"),
        "orders_failed_count": F.col("failed_n"),
        "revenue_rub": F.col("amount"),
        "cost_rub": F.col("cost"),
        "profit_rub": F.col("profit"),
        "avg_check_rub": v.exact_mean(F.col("amount"), F.col("amount_n")),
    }


# --- marts ---------------------------------------------------------------------------------


def build_daily(
    core: CoreTables,
    rng: DateRange,
    cfg: Settings,
    mix: DataFrame | None = None,
    buyers: DataFrame | None = None,
) -> DataFrame:
    """One row per day of the range, days without orders included.

    The cancelled count is always 0. Distinct and repeat buyers come from the user-day grain:
    the first skip the NULL user, the second count it as one buyer.
    """
    totals = (
        sales_totals(core.events("orders"), rng, cfg) if mix is None else _rolled_up(mix, ("date",))
    )
    by_user = buyer_days(core, rng, cfg) if buyers is None else buyers
    buyer_counts = by_user.groupBy("date").agg(
        F.count("user_id").alias("unique_buyers_count"),
        F.count_if(F.col("paid_n") >= 2).alias("repeat_buyers_count"),
    )
    sales = totals.withColumns(_sales_columns()).withColumns(
        {
            "orders_cancelled_count": F.lit(0),
            "pay_conversion_rate": v.exact_rate(F.col("paid_n"), F.col("created_n")),
        }
    )
    return shaped("daily", fill_days(core.spark, rng, sales, buyer_counts))


def build_provider_daily(
    core: CoreTables, rng: DateRange, cfg: Settings, mix: DataFrame | None = None
) -> DataFrame:
    keys = ("date", "payment_provider")
    totals = (
        sales_totals(core.events("orders"), rng, cfg, keys[1:]) if mix is None else _rolled_up(mix, keys)
    )
    conversion = v.exact_rate(F.col("paid_n"), F.col("created_n"))
    return shaped(
        "provider_daily",
        totals.withColumns(_sales_columns()).withColumn("paid_conversion_rate", conversion),
    )


def build_product_daily(
    core: CoreTables, rng: DateRange, cfg: Settings, mix: DataFrame | None = None
) -> DataFrame:
    keys = ("date", "product_type")
    totals = (
        sales_totals(core.events("orders"), rng, cfg, keys[1:]) if mix is None else _rolled_up(mix, keys)
    )
    return shaped("product_daily", totals.withColumns(_sales_columns()))


def referred_ids(core: CoreTables) -> DataFrame:
    """Users with a referrer; an empty referrer text counts as one."""
    return core.events("users").where(F.col("referrer_id").isNotNull()).select("user_id")


def referred_signups(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    referred = core.events("users").where(F.col("referrer_id").isNotNull())
    return (
        cal.within(referred, "created_at", rng, cfg.zone)
        .groupBy("date")
        .agg(F.count("*").alias("new_referred_users_count"))
    )


def referral_bonuses(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Bonus cost by day. Stars are summed per (day, order) before the orders are looked up, so an
    order with a large share of the earnings meets the join as one row per day."""
    stars = (
        cal.within(
            core.events("referral_earnings").where(F.col("order_id").isNotNull()),
            "created_at",
            rng,
            cfg.zone,
        )
        .groupBy("date", "order_id")
        .agg(F.sum("stars").alias("stars"))
        .where(F.col("stars") != 0)
    )
    prices = core.events("orders").where(F.col("cost_per_star") != 0).select("order_id", "cost_per_star")
    return (
        stars.join(prices, "order_id")
        .groupBy("date")
        .agg(F.sum(v.bonus_cost()).alias("referral_bonus_cost_rub"))
    )


def build_referral_daily(
    core: CoreTables, rng: DateRange, cfg: Settings, buyers: DataFrame | None = None
) -> DataFrame:
    """Sign-ups with a referrer, what referred users bought, and what the referrals cost.

    Orders are collapsed to (day, user) before they meet the users.
    """
    by_user = buyer_days(core, rng, cfg) if buyers is None else buyers
    bought = (
        by_user.join(referred_ids(core), "user_id")
        .groupBy("date")
        .agg(
            F.count("*").alias("referred_buyers_count"),
            F.sum("paid_n").alias("referred_orders_paid_count"),
            v.money(v.from_kopecks(F.sum("kopecks"))).alias("referred_revenue_rub"),
            v.money(v.from_kopecks(F.sum("profit_kopecks"))).alias("order_profit"),
        )
    )
    bonus = referral_bonuses(core, rng, cfg).select(
        "date", v.money(F.col("referral_bonus_cost_rub")).alias("referral_bonus_cost_rub")
    )
    filled = fill_days(core.spark, rng, referred_signups(core, rng, cfg), bought, bonus)
    profit = v.money_or_zero(F.col("order_profit")) - v.money_or_zero(
        F.col("referral_bonus_cost_rub")
    )
    return shaped("referral_daily", filled.withColumn("referral_profit_rub", profit))


def build_promo_daily(core: CoreTables, rng: DateRange, cfg: Settings) -> DataFrame:
    """Redemptions beside paid orders by (day, code). NULL codes are dropped, empty ones kept."""
    redeemed = (
        cal.within(
            core.events("promo_redemptions").where(F.col("code").isNotNull()), "created_at", rng, cfg.zone
        )
        .groupBy("date", F.col("code").alias("promo_code"))
        .agg(F.count("*").alias("redemptions_count"))
    )
    bought = (
        cal.within(
            core.events("orders").where(v.is_paid(cfg) & F.col("promo_code").isNotNull()),
            "timestamp",
            rng,
            cfg.zone,
        )
        .groupBy("date", "promo_code")
        .agg(
            F.count("*").alias("paid_orders_count"),
            v.sum_money(v.promo_discount()).alias("discount_total_rub"),
            v.sum_money(F.col("amount_rub")).alias("revenue_after_discount_rub"),
            v.sum_money(v.effective_profit(cfg)).alias("profit_after_discount_rub"),
        )
    )
    return shaped("promo_daily", redeemed.join(bought, ["date", "promo_code"], "full_outer"))


def _first_weeks(user_weeks: DataFrame, weeks: DateRange, firsts: DataFrame | None) -> DataFrame:
    """The (user, week) rows of the range's cohorts, with the week of the first purchase."""
    if firsts is None:
        first = F.min("week").over(Window.partitionBy("user_id"))
        return user_weeks.withColumn("cohort_week", first).where(weeks.holds(F.col("cohort_week")))
    members = firsts.select(
        F.col("user_id").alias("member"), cal.week_start(F.col("first_date")).alias("cohort_week")
    ).where(weeks.holds(F.col("cohort_week")))
    return user_weeks.join(members, F.col("user_id").eqNullSafe(F.col("member"))).drop("member")


def build_cohort_weekly(
    core: CoreTables, rng: DateRange, cfg: Settings, firsts: DataFrame | None = None
) -> DataFrame:
    """Weekly buyer cohorts by week of age.

    Orders are collapsed to (user, week) first. The user's first week is then a window over at
    most one row per week, which spares the join of the orders with their own minimum. The NULL
    user adds to its cohort's size but is never active. History is read up to the last week any
    cohort of the range can reach.

    With ``firsts`` (user_id, first_date), as kept by ``plans.purchases``, no order before the
    range is read: only members of the range's cohorts are joined, one row a user.
    """
    weeks = rng.weeks()
    last_day = weeks.end + DAY * (7 * COHORT_AGES - 1)
    paid = core.events("orders").where(v.is_paid(cfg))
    read = (
        cal.up_to(paid, "timestamp", last_day, cfg.zone) if firsts is None
        else cal.within(paid, "timestamp", DateRange(weeks.start, last_day), cfg.zone)
    )
    user_weeks = read.groupBy("user_id", cal.week_start(F.col("date")).alias("week")).agg(
        v.sum_kopecks(F.col("amount_rub")).alias("kopecks")
    )
    known = F.col("user_id").isNotNull()
    activity = (
        _first_weeks(user_weeks, weeks, firsts)
        .withColumn("age_week", cal.week_age(F.col("week"), F.col("cohort_week")))
        .where(F.col("age_week") < COHORT_AGES)
        .groupBy("cohort_week", "age_week")
        .agg(
            F.count("*").alias("members"),
            F.count("user_id").alias("repeat_buyers_count"),
            v.money_or_zero(v.from_kopecks(F.sum(F.when(known, F.col("kopecks"))))).alias(
                "period_revenue_rub"
            ),
        )
    )
    size = F.max(F.when(F.col("age_week") == 0, F.col("members"))).over(
        Window.partitionBy("cohort_week")
    )
    sized = (
        activity.withColumn("users_count", size)
        .where(F.col("repeat_buyers_count") > 0)
        .withColumns(
            {
                "retention_rate": v.exact_rate(F.col("repeat_buyers_count"), F.col("users_count")),
                "cumulative_revenue_rub": running_sum(
                    "period_revenue_rub", "cohort_week", "age_week"
                ),
            }
        )
    )
    return shaped("cohort_weekly", sized)


BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "daily": build_daily,
    "provider_daily": build_provider_daily,
    "product_daily": build_product_daily,
    "referral_daily": build_referral_daily,
    "promo_daily": build_promo_daily,
    "cohort_weekly": build_cohort_weekly,
}


class Marts:
    """The marts by name: stored ones, or ones still to be computed. Looked up on first use."""

    def __init__(self, fetch: Callable[[str], DataFrame]) -> None:
        self._fetch = fetch

    @cached_property
    def daily(self) -> DataFrame:
        return self._fetch("daily")

    @cached_property
    def provider_daily(self) -> DataFrame:
        return self._fetch("provider_daily")

    @cached_property
    def product_daily(self) -> DataFrame:
        return self._fetch("product_daily")

    @cached_property
    def referral_daily(self) -> DataFrame:
        return self._fetch("referral_daily")

    @cached_property
    def promo_daily(self) -> DataFrame:
        return self._fetch("promo_daily")

    @cached_property
    def cohort_weekly(self) -> DataFrame:
        return self._fetch("cohort_weekly")


def derive_marts(core: CoreTables, rng: DateRange, cfg: Settings) -> Marts:
    """Marts straight from the core tables, computed only where a query uses them."""
    return Marts(lambda name: BUILDERS[name](core, rng, cfg))
