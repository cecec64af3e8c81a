"""Re-aggregations shown on the overview pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions import values as v
from martwright.operators.frames import align_from_end, top, totals_by
from martwright.plans.marts import Marts
from martwright.ranges import DateRange

# Fixed values.
BAR_COUNT = 6
COHORT_WEEKS, COHORT_COLUMNS, COHORT_LIST = 8, 8, 40
REFERRAL_DAYS = 31
WEEKDAYS, HOURS = 7, 24


def provider_totals(marts: Marts, rng: DateRange) -> DataFrame:
    sums = totals_by(
        marts.provider_daily.where(rng.holds(F.col("date"))),
        "payment_provider",
        ["orders_created_count", "orders_paid_count", "revenue_rub"],
        "revenue_rub",
    )
    conversion = v.share(F.col("orders_paid_count"), F.col("orders_created_count"))
    return sums.withColumn("paid_conversion_rate", conversion)


def product_totals(marts: Marts, rng: DateRange) -> DataFrame:
    return totals_by(
        marts.product_daily.where(rng.holds(F.col("date"))),
        "product_type",
        ["orders_paid_count", "revenue_rub", "profit_rub"],
        "revenue_rub",
    )


def promo_totals(marts: Marts, rng: DateRange) -> DataFrame:
    return totals_by(
        marts.promo_daily.where(rng.holds(F.col("date"))),
        "promo_code",
        [
            "redemptions_count",
            "paid_orders_count",
            "discount_total_rub",
            "revenue_after_discount_rub",
            "profit_after_discount_rub",
        ],
        "revenue_after_discount_rub",
    )


def period_compare(marts: Marts, rng: DateRange, value: str = "revenue_rub") -> DataFrame:
    """A daily measure beside the same measure of the period before, point by point."""
    before = rng.previous()
    return align_from_end(
        marts.daily.where(rng.holds(F.col("date"))),
        marts.daily.where(before.holds(F.col("date"))),
        value,
    ).orderBy("date")


def cohort_cells(
    cohorts: DataFrame, ages: int = COHORT_COLUMNS, weeks: int | None = COHORT_WEEKS
) -> DataFrame:
    """(cohort_week, place, age_week, retention_rate) of the latest cohorts and the first ``ages``
    ages that any cohort has; a cell that a cohort lacks is 0.

    Both lists are short: ages stop at the mart's last one, cohorts are weeks.
    """
    held = cohorts.groupBy("cohort_week", "age_week").agg(
        F.max("retention_rate").cast("double").alias("rate")
    )
    shown = top(cohorts.select("age_week").distinct(), ages, F.asc("age_week"))
    shown = shown.agg(F.sort_array(F.collect_list("age_week")).alias("listed"))
    latest = top(cohorts.select("cohort_week").distinct(), weeks, F.desc("cohort_week"))
    grid = latest.select("cohort_week", F.posexplode(
        F.coalesce(shown.scalar(), F.array().cast("array<int>"))).alias("place", "age_week"))
    return grid.join(held, ["cohort_week", "age_week"], "left").select(
        "cohort_week", "place", "age_week", F.coalesce("rate", F.lit(0.0)).alias("retention_rate")
    ).orderBy(F.desc("cohort_week"), "place")


def cohort_matrix(
    cohorts: DataFrame,
    ages: Sequence[int] | None = None,
    weeks: int | None = COHORT_WEEKS,
) -> DataFrame:
    """Retention of the latest ``weeks`` cohorts (None: all), one column per age; an absent cell
    is 0. Without ``ages`` they are the first eight that any cohort has; a small job finds them."""
    if ages is None:
        present = top(cohorts.select("age_week").distinct(), COHORT_COLUMNS, F.asc("age_week"))
        ages = [r.age_week for r in present.collect()]
    cells = [
        F.coalesce(F.max(F.when(F.col("age_week") == a, F.col("retention_rate"))), F.lit(0))
        .cast("double")
        .alias(f"age_{a}")
        for a in ages
    ]
    # Without any age there is no cohort either.
    found = cohorts.groupBy("cohort_week").agg(*(cells or [F.count("*").alias("n")]))
    return top(found.select("cohort_week", *[f"age_{a}" for a in ages]), weeks, F.desc("cohort_week"))


def hourly_matrix(heatmap: DataFrame) -> DataFrame:
    """Every weekday and hour; intensity is the share of the busiest cell."""
    grid = heatmap.sparkSession.range(0, WEEKDAYS * HOURS, 1, 1).select(
        (F.col("id") / HOURS + 1).cast("int").alias("iso_dow"),
        (F.col("id") % HOURS).cast("int").alias("hour"),
    )
    busiest = heatmap.agg(
        F.greatest(F.coalesce(F.max("paid_orders_count"), F.lit(1)), F.lit(1)).alias("m")
    ).scalar()
    # At most one row per weekday and hour.
    cells = F.broadcast(heatmap.select("iso_dow", "hour", "paid_orders_count"))
    paid = v.zero(F.col("paid_orders_count"))
    return (
        grid.join(cells, ["iso_dow", "hour"], "left")
        .select(
            "iso_dow",
            "hour",
            paid.alias("paid_orders_count"),
            (paid.cast("double") / busiest.cast("double")).alias("intensity"),
        )
        .orderBy("iso_dow", "hour")
    )


def provider_success(payment_providers: DataFrame) -> DataFrame:
    """Share of successful attempts by provider, over the payments-by-provider view."""
    return payment_providers.select(
        "provider",
        "payment_attempts_count",
        "payment_success_count",
        v.share(F.col("payment_success_count"), F.col("payment_attempts_count")).alias(
            "success_rate"
        ),
    )


def provider_bars(marts: Marts, rng: DateRange, count: int | None = BAR_COUNT) -> DataFrame:
    """The ``count`` largest providers by revenue (None: all), each with its share of the
    largest."""
    totals = provider_totals(marts, rng)
    bars = (
        (totals if count is None else totals.limit(count))
        .select("payment_provider", F.col("revenue_rub").cast("double").alias("revenue_rub"))
    )
    longest = bars.agg(
        F.greatest(F.coalesce(F.max("revenue_rub"), F.lit(1.0)), F.lit(1.0)).alias("m")
    ).scalar()
    return bars.select(
        "payment_provider", "revenue_rub", (F.col("revenue_rub") / longest).alias("share_of_max")
    )


def recent_referrals(items: DataFrame, days: int | None = REFERRAL_DAYS) -> DataFrame:
    return top(items, days, F.desc("date"))


def first_cohorts(cohorts: DataFrame, rows: int | None = COHORT_LIST) -> DataFrame:
    return top(cohorts, rows, F.asc("cohort_week"), F.asc("age_week"))
