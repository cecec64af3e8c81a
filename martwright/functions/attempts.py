"""Identity and outcome of a payment attempt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martwright.functions.values import or_unknown
from martwright.settings import Settings


def provider_name(cfg: Settings) -> Column:
    """Provider label with status-feed aliases folded into their provider."""
    label = or_unknown(F.col("provider"))
    named = None
    for alias, target in cfg.provider_aliases.items():
        test = label == alias
        named = F.when(test, target) if named is None else named.when(test, target)
    return label if named is None else named.otherwise(label)


def attempt_key(cfg: Settings) -> Column:
    """First identity that exists: provider and its transaction, the order, the row itself."""
    return F.coalesce(
        F.concat(
            provider_name(cfg), F.lit(":"), F.nullif(F.col("provider_txn_id"), F.lit(""))
        ),
        F.concat(F.lit("order:"), F.col("order_id")),
        F.concat(F.lit("row:"), F.col("id").cast("string")),
    )


def is_success(cfg: Settings) -> Column:
    """1 for a success status; anything else, NULL included, is 0."""
    return F.when(F.col("status").isin(cfg.payment_success), 1).otherwise(0)
