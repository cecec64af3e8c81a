"""Small relational building blocks shared by the plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.ranges import DateRange


def fill_days(spark: SparkSession, rng: DateRange, *by_date: DataFrame) -> DataFrame:
    """Every day of the range, left-joined with frames that hold one row per day."""
    return reduce(
        lambda left, right: left.join(right, "date", "left"),
        by_date,
        rng.spine(spark),
    )


def top(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The first ``n`` rows in this order; all of them, ordered, if ``n`` is None."""
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def clamp_limit(value, default: int = 200, most: int = 1000) -> int:
    """Row limit of a request inside 1..most; the default stands in for a missing one.

    For front ends that must bound a page. The queries themselves take any limit, or None.
    """
    wanted = default if value is None else int(value)
    return min(max(wanted, 1), most)


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters, one per given value; None and '' mean no filter."""
    for name, value in wanted.items():
        if value is not None and value != "":
            df = df.where(F.col(name) == F.lit(value))
    return df


def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side, without a join.

    The rows are stacked and each column's only non-NULL value is kept.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def running_sum(value: str, by: str, order: str) -> Column:
    rows = Window.partitionBy(by).orderBy(order)
    return F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def attach_names(
    listed: DataFrame, table: DataFrame, key: str, columns: Sequence[str], limit: int | None
) -> DataFrame:
    """Left-join columns of a large keyed table onto a list. ``key`` is unique in ``table``.

    A ``limit`` the list ends in bounds its keys, so the table is cut down by a broadcast
    semi-join where it is scanned. Without one the sizes Spark measures decide.
    """
    keys = listed.select(key).where(F.col(key).isNotNull()).distinct()
    hits = table.select(key, *columns).join(
        keys if limit is None else F.broadcast(keys), key, "left_semi"
    )
    return listed.join(hits, key, "left")


#: Buckets of a reducer: at most so many numbers are broadcast, 8 MB, whatever the tables hold.
REDUCER_BUCKETS = 1 << 20


def reduced(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among those of ``wanted``: a filter before a shuffle.

    Both sides' keys fall into buckets by their hash, and the buckets in use are broadcast, a Bloom
    filter of one hash. Rows of other keys that share a bucket stay, so a join must follow; with
    far fewer wanted keys than buckets nearly all others go where they are scanned.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(REDUCER_BUCKETS))
    used = wanted.where(F.col(key).isNotNull()).select(bucket.alias("__bucket")).distinct()
    marked = df.withColumn("__bucket", bucket)
    return marked.join(F.broadcast(used), "__bucket", "left_semi").drop("__bucket")


def totals_by(df: DataFrame, key: str, measures: Sequence[str], largest: str) -> DataFrame:
    """Sums by label over a range, largest first."""
    label = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown"))
    sums = [F.sum(m).alias(m) for m in measures]
    return (
        df.groupBy(label.alias(key)).agg(*sums).orderBy(F.desc(largest), F.asc(key))
    )


def z_scores(df: DataFrame, metrics: Sequence[str], key: str = "date") -> DataFrame:
    """(key, metric, value, z) for each metric against its own mean and population deviation.

    The statistics of all metrics come from one scalar subquery, so no window gathers the rows in
    one task; a deviation of practically zero scores 0.
    """
    typed = df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics])
    stats = typed.agg(
        F.struct(
            *[
                F.struct(F.avg(m).alias("mean"), F.stddev_pop(m).alias("dev")).alias(m)
                for m in metrics
            ]
        ).alias("stats")
    ).scalar()

    def scored(metric: str) -> Column:
        mean, dev = stats[metric]["mean"], stats[metric]["dev"]
        z = F.when(dev <= 0.000001, 0.0).otherwise((F.col(metric) - mean) / dev)
        return F.struct(
            F.lit(metric).alias("metric"), F.col(metric).alias("value"), z.alias("z")
        )

    return typed.select(key, F.inline(F.array(*[scored(m) for m in metrics])))


def align_from_end(
    current: DataFrame, previous: DataFrame, value: str, order: str = "date"
) -> DataFrame:
    """Pair two series by their distance from the last point; a missing earlier point is 0.

    Each series holds one row per day, so its window is bounded by the length of the range.
    """
    both = (
        current.select(order, F.col(value).alias("v"), F.lit("current").alias("series"))
        .unionByName(
            previous.select(order, F.col(value).alias("v"), F.lit("previous").alias("series"))
        )
        .withColumn(
            "back",
            F.row_number().over(Window.partitionBy("series").orderBy(F.desc(order))),
        )
    )
    now, before = F.col("series") == "current", F.col("series") == "previous"
    return (
        both.groupBy("back")
        .agg(
            F.max(F.when(now, F.col(order))).alias(order),
            F.max(F.when(now, F.col("v"))).alias("current_value"),
            F.max(F.when(before, F.col("v"))).alias("previous_value"),
        )
        .where(F.col(order).isNotNull())
        .select(
            order,
            F.coalesce("current_value", F.lit(0)).alias("current_value"),
            F.coalesce("previous_value", F.lit(0)).alias("previous_value"),
        )
        .withColumn("difference", F.col("current_value") - F.col("previous_value"))
    )
