"""Recompute the sales marts for the days touched by arriving order files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from martwright.functions import calendar as cal
from martwright.plans.jobs import Environment, refresh_sales
from martwright.ranges import DaySet


def touched_days(batch: DataFrame, zone: str) -> DataFrame:
    date = cal.local_date(F.col("timestamp"), zone).alias("date")
    return batch.select(date).where(F.col("date").isNotNull()).distinct()


def order_days(orders: DataFrame, zone: str) -> DataFrame:
    """(key, days): every day on which an order has been seen, as a running state of a stream.

    The state holds the distinct days of an order, so that a row which moves an order names the
    days it leaves as well. Rows without an order id cannot move; their key is their day, so that
    they share no state but that of their day.
    """
    date = cal.local_date(F.col("timestamp"), zone)
    own = F.concat(F.lit("order "), F.col("order_id"))
    return (
        orders.select(F.coalesce(own, F.concat(F.lit("day "), date.cast("string"))).alias("key"),
                      date.alias("date"))
        .where(F.col("key").isNotNull())
        .groupBy("key").agg(F.collect_set("date").alias("days"))
    )


def refresh_days(env: Environment, days: DataFrame, everything: bool = False) -> None:
    """Rebuild the days of a column ``date`` from the whole orders table and upsert them.

    The driver gets these days, at most one row a day of the calendar. Only their rows are read,
    and only their months are rewritten; the number of jobs does not depend on how many there are
    or how they lie. A replayed batch writes the same rows again.
    """
    listed = [r.date for r in days.where(F.col("date").isNotNull()).distinct().collect()]
    if listed:
        refresh_sales(env.reopened(), DaySet.of(listed), everything)


def refresh_touched(env: Environment, batch: DataFrame, everything: bool = False) -> None:
    """Refresh the days of these order rows. Days that their orders leave are not known here; see
    ``stream_refresh``."""
    refresh_days(env, touched_days(batch, env.cfg.zone), everything)


def stream_refresh(
    spark: SparkSession,
    env: Environment,
    source: str,
    schema: T.StructType,
    checkpoint: str,
    as_orders: Callable[[DataFrame], DataFrame] = lambda df: df,
    everything: bool = False,
) -> StreamingQuery:
    """Start one pass over the files not yet seen; await the returned query.

    ``source`` is a folder or glob of Parquet order files and ``as_orders`` maps its rows to order
    rows. ``env.core.orders`` is expected to show the current version of every order; it is opened
    anew for each batch. With ``everything`` the referral and promo marts of the days follow too.

    The stream keeps the days of each order as its state, below ``checkpoint``: an order that
    arrives again on another day refreshes the day it left and the day it went to, however far
    apart. The state takes one row an order; batches only touch the rows of their orders.
    """
    arriving = as_orders(spark.readStream.schema(schema).parquet(source))

    def on_batch(batch: DataFrame, _batch_id: int) -> None:
        refresh_days(env, batch.select(F.explode("days").alias("date")), everything)

    return (
        order_days(arriving, env.cfg.zone)
        .writeStream.outputMode("update").foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
