"""Frequent refresh from what has arrived since: sums of new files are added to kept sums.

For sources to which order rows are only added, each row once. Every micro-batch reads its new files
and nothing else of the orders: it leaves two small tables, sums by (day, provider, product) and by
(day, buyer), as the part of its batch number. Sums add up over parts in any order, and a batch that
is replayed replaces its own part, so nothing counts twice. The marts of the touched days are then
made from the kept sums. Old parts are folded into one from time to time.

Where rows are corrected or moved, ``refresh.stream_refresh`` reads the touched days again instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from martwright.functions import calendar as cal
from martwright.operators.versions import VersionedFolder
from martwright.plans import marts as m
from martwright.plans.jobs import Environment, write_sales
from martwright.ranges import DateRange, DaySet
from martwright.sources.core import CoreTables

BATCH = "batch"
FOLDED = "folded"
SUMS = {"sales_deltas": ("date", "payment_provider", "product_type"),
        "buyer_deltas": ("date", "user_id")}


@dataclass(frozen=True)
class DeltaStore:
    """The kept sums, below the marts' folder."""

    spark: SparkSession
    root: str

    def _folder(self, name: str) -> VersionedFolder:
        return VersionedFolder(self.spark, f"{self.root}/{name}", BATCH)

    def put(self, name: str, batch: int, sums: DataFrame) -> None:
        folder = self._folder(name)
        base = folder.current()
        if self._is_folded(base, batch):
            return
        # Few files, and as many tasks as run at once.
        files = max(8, self.spark.sparkContext.defaultParallelism)
        parts = folder.write(sums.withColumn(BATCH, F.lit(str(batch))).coalesce(files))
        folder.publish(base, [str(batch)], parts)

    @staticmethod
    def _is_folded(version, batch: int) -> bool:
        """A folded part is named by the last batch that it holds."""
        return any(p.startswith(FOLDED) and int(p.partition("-")[2]) >= batch for p in version.parts)

    def sums(self, name: str, schema: T.StructType, days: DateRange | None = None) -> DataFrame:
        """Kept sums over all batches, of all or some days."""
        folder = self._folder(name)
        whole = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])
        rows = folder.read(folder.current(), whole).drop(BATCH)
        if days is not None:
            rows = rows.where(days.holds(F.col("date")))
        keys = SUMS[name]
        added = [F.sum(c).cast(schema[c].dataType).alias(c) for c in schema.names if c not in keys]
        return rows.groupBy(*keys).agg(*added)

    def fold(self, name: str, schema: T.StructType) -> None:
        """Make one part of all but the last batch, which may yet be replayed."""
        folder = self._folder(name)
        base = folder.current()
        numbered = sorted(int(p) for p in base.parts if not p.startswith(FOLDED))
        done = [str(n) for n in numbered[:-1]]
        if not done:
            return
        old = [p for p in base.parts if p.startswith(FOLDED)] + done
        whole = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])
        rows = folder.read(base, whole, old).drop(BATCH)
        added = [F.sum(c).cast(schema[c].dataType).alias(c) for c in schema.names
                 if c not in SUMS[name]]
        folded = rows.groupBy(*SUMS[name]).agg(*added).select(*schema.names)
        parts = folder.write(
            folded.withColumn(BATCH, F.lit(f"{FOLDED}-{done[-1]}"))
            .repartitionByRange("date").sortWithinPartitions("date")
        )
        folder.publish(base, old, parts)


def add_batch(
    env: Environment, deltas: DeltaStore, orders: DataFrame, batch: int, fold_every: int = 32
) -> None:
    """Add one batch of new order rows and refresh the sales marts of their days.

    The driver gets the days of the batch, at most one row a day of the calendar.
    """
    dated = orders.where(F.col("timestamp").isNotNull())
    core = CoreTables(lambda name: dated)
    span = DateRange(*_span(dated, env))
    made = {"sales_deltas": m.sales_mix(core, span, env.cfg),
            "buyer_deltas": m.buyer_days(core, span, env.cfg)}
    schemas = {name: df.schema for name, df in made.items()}
    for name, df in made.items():
        deltas.put(name, batch, df)
    folder = deltas._folder("sales_deltas")
    version = folder.current()
    if str(batch) not in version.parts:
        return  # without dated rows, or folded long ago
    whole = T.StructType([*schemas["sales_deltas"].fields, T.StructField(BATCH, T.StringType())])
    listed = folder.read(version, whole, [str(batch)]).select("date").distinct().collect()
    days = DaySet.of([r.date for r in listed])
    write_sales(
        env, days,
        deltas.sums("sales_deltas", schemas["sales_deltas"], days),
        deltas.sums("buyer_deltas", schemas["buyer_deltas"], days),
    )
    if batch and batch % fold_every == 0:
        for name, schema in schemas.items():
            deltas.fold(name, schema)


def _span(orders: DataFrame, env: Environment):
    """First and last local day of the batch; the default of a batch without any is one day."""
    day = cal.local_date(F.col("timestamp"), env.cfg.zone)
    first, last = orders.agg(F.min(day), F.max(day)).first()
    return (first, last) if first else (env.cfg.today(), env.cfg.today())


def stream_deltas(
    spark: SparkSession,
    env: Environment,
    source: str,
    schema: T.StructType,
    checkpoint: str,
    as_orders: Callable[[DataFrame], DataFrame] = lambda df: df,
    fold_every: int = 32,
    **options: str,
) -> StreamingQuery:
    """Start one pass over the files not yet seen; await the returned query.

    The checkpoint knows which files have been read. ``options`` go to the file source, such as
    ``maxFilesPerTrigger``.
    """
    deltas = DeltaStore(spark, env.store.root)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        add_batch(env, deltas, as_orders(batch), batch_id, fold_every)

    return (
        spark.readStream.schema(schema).options(**options).parquet(source)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
