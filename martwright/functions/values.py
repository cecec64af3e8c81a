"""Column expressions for order money, labels and ratios."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from martwright.settings import Settings

MONEY = "decimal(14,2)"
RATE = "decimal(8,4)"


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_unknown(c: Column) -> Column:
    return F.coalesce(_filled(c), F.lit("unknown"))


def or_dash(c: Column) -> Column:
    return F.coalesce(_filled(c), F.lit("-"))


def null_to_dash(c: Column) -> Column:
    """Only NULL becomes a dash; an empty text stays."""
    return F.coalesce(c, F.lit("-"))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def money(c: Column) -> Column:
    return c.cast(MONEY)


def money_or_zero(c: Column) -> Column:
    return F.coalesce(c.cast(MONEY), F.lit(Decimal("0.00")).cast(MONEY))


def sum_kopecks(c: Column) -> Column:
    """Exact sum of two-decimal money as a whole number of kopecks.

    Summing decimal(14,2) directly needs a buffer wider than a machine word and costs several
    times as much per row. A sum that fits a stored money column is far from the word's limit.
    """
    return F.sum((c * 100).cast("bigint"))


def from_kopecks(c: Column) -> Column:
    return c.cast("decimal(20,0)") * F.lit(Decimal("0.01"))


def sum_money(c: Column) -> Column:
    return from_kopecks(sum_kopecks(c))


def is_paid(cfg: Settings) -> Column:
    return F.col("status").isin(cfg.paid)


def is_failed(cfg: Settings) -> Column:
    return F.col("status").isin(cfg.failed)


def effective_cost(cfg: Settings) -> Column:
    """A positive recorded cost wins; else gifts take their default, the rest what is there."""
    cost = F.col("cost_rub")
    return (
        F.when(cost > 0, cost)
        .when(F.col("product_type") == "gift", F.lit(cfg.gift_default_cost).cast(MONEY))
        .otherwise(F.coalesce(cost, F.lit(0).cast(MONEY)))
    )


def gross_profit(cfg: Settings) -> Column:
    """Amount minus effective cost, whatever profit was recorded."""
    return F.coalesce(F.col("amount_rub"), F.lit(0).cast(MONEY)) - effective_cost(cfg)


def effective_profit(cfg: Settings) -> Column:
    """Recorded profit, else gross profit."""
    return F.coalesce(F.col("profit_rub"), gross_profit(cfg))


def promo_discount() -> Column:
    paid = F.col("amount_rub")
    before = F.coalesce(F.col("amount_rub_original"), paid)
    return before - F.coalesce(paid, F.lit(0).cast(MONEY))


def bonus_cost() -> Column:
    """Stars of a referral earning at the price of the order they were earned on."""
    return F.coalesce(F.col("cost_per_star"), F.lit(0).cast("decimal(14,4)")) * zero(F.col("stars"))


def share(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, 0 where the whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def rate(part: Column, whole: Column) -> Column:
    return F.round(share(part, whole), 4)


def mean_money(total: Column, count: Column) -> Column:
    return F.round(share(total, count), 2)


def exact_rate(part: Column, whole: Column) -> Column:
    """Stored ratio of two counts, rounded once from the exact quotient."""
    wide = "decimal(20,0)"
    quotient = part.cast(wide) / F.nullif(whole.cast(wide), F.lit(0).cast(wide))
    return F.coalesce(F.round(quotient, 4).cast(RATE), F.lit(0).cast(RATE))


def exact_mean(total: Column, count: Column) -> Column:
    """Stored money average: sum / count in wide decimal, rounded once."""
    wide = "decimal(20,0)"
    quotient = total / F.nullif(count.cast(wide), F.lit(0).cast(wide))
    return F.coalesce(quotient.cast(MONEY), F.lit(0).cast(MONEY))


def plain_decimal(c: Column) -> Column:
    """Money as text with at least one decimal digit: 12.50 becomes 12.5, -1.00 becomes -1.0."""
    return F.regexp_replace(c.cast("string"), r"(\.\d)0$", "$1")
