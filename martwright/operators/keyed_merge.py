"""Insert-or-update of keyed rows, as a pure function of two frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_rows(
    existing: DataFrame, updates: DataFrame, keys: Sequence[str], stamp: Column
) -> DataFrame:
    """Existing rows with the updates laid over them.

    An update replaces the measures and moves ``updated_at`` but keeps ``created_at``; a new key
    gets both; a key absent from the updates stays as it is. Keys are unique on both sides.
    """
    measures = [c for c in updates.columns if c not in keys]
    old = existing.select(
        *keys, F.struct(*measures, "created_at", "updated_at").alias("old")
    )
    new = updates.select(*keys, F.struct(*measures).alias("new"))
    replaced = F.col("new").isNotNull()

    def pick(name: str) -> Column:
        return F.when(replaced, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return old.join(new, list(keys), "full_outer").select(
        *keys,
        *[pick(m) for m in measures],
        F.coalesce(F.col("old.created_at"), stamp).alias("created_at"),
        F.when(replaced, stamp).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )
