"""Sums of arriving files: the marts are those of a full rebuild, whatever arrives when."""

import random

from pyspark.sql import functions as F

from checks import catalog
from martwright.plans import jobs, marts
from martwright.settings import Settings
from martwright.sources.core import CoreTables
from martwright.sources.sample import sample_core
from martwright.sources.store import MartStore
from martwright.streaming.deltas import BATCH, FOLDED, DeltaStore, add_batch, stream_deltas
from tests.conftest import SMALL, rows, utc

CFG = Settings(clock=lambda: utc("2011-04-01 00:00:00"))
NAMES = ("daily", "provider_daily", "product_daily")


def table(df):
    return sorted(map(str, rows(df)))


def same_as_rebuilt(env, orders):
    core = CoreTables(lambda name: orders)
    for name in NAMES:
        want = marts.BUILDERS[name](core, catalog.FULL, CFG)
        if name == "daily":
            want = want.where("orders_created_count > 0")
        assert table(env.store.read(name).drop("created_at", "updated_at")) == table(want), name


def never(name):
    raise AssertionError(f"{name} is read")


def test_random_arrival_replays_and_folding(spark, tmp_path):
    """Orders in random batches, each replayed once, some folded; the whole table is never read."""
    orders = sample_core(spark, SMALL).orders.withColumn("lot", F.abs(F.hash("order_id")) % 6)
    orders = orders.cache()
    spine = CoreTables(lambda name: orders.drop("lot").limit(0) if name == "orders" else never(name))
    env = jobs.Environment(spine, MartStore(spark, str(tmp_path / "s")), CFG)
    deltas = DeltaStore(spark, env.store.root)
    lots = list(range(6))
    random.Random(3).shuffle(lots)
    for batch, lot in enumerate(lots):
        arriving = orders.where(F.col("lot") == lot).drop("lot")
        add_batch(env, deltas, arriving, batch, fold_every=2)
        if batch % 2:
            add_batch(env, deltas, arriving, batch, fold_every=2)
    same_as_rebuilt(env, orders.drop("lot"))
    parts = deltas._folder("sales_deltas").current().parts
    assert sorted(parts) == ["4", "5", f"{FOLDED}-3"]
    before = table(env.store.read("daily"))
    add_batch(env, deltas, orders.where(F.col("lot") == lots[1]).drop("lot"), 1)  # long folded
    assert table(env.store.read("daily")) == before
    assert deltas._folder("buyer_deltas").part_by == BATCH
    orders.unpersist()


def test_batches_without_rows_or_times(spark, tmp_path):
    orders = sample_core(spark, SMALL).orders
    env = jobs.Environment(CoreTables(lambda n: orders), MartStore(spark, str(tmp_path / "s")), CFG)
    deltas = DeltaStore(spark, env.store.root)
    add_batch(env, deltas, orders.limit(0), 0)
    add_batch(env, deltas, orders.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")), 1)
    assert env.store.read("daily").count() == 0


def test_the_stream_reads_new_files_only(spark, tmp_path):
    orders = sample_core(spark, SMALL).orders
    folder = str(tmp_path / "orders")
    env = jobs.Environment(CoreTables(lambda n: orders.limit(0)),
                           MartStore(spark, str(tmp_path / "s")), CFG)
    first = F.abs(F.hash("order_id")) % 2 == 0
    arrived = orders.limit(0)
    for some in (orders.where(first), orders.where(~first), None):
        if some is not None:
            some.repartition(2).write.mode("append").parquet(folder)
            arrived = arrived.union(some)
        query = stream_deltas(spark, env, folder, orders.schema, str(tmp_path / "p"))
        query.awaitTermination()
        read = sum(p["numInputRows"] for p in query.recentProgress)
        assert read <= 5 * (some.count() if some is not None else 0)  # passes over the new rows
        same_as_rebuilt(env, arrived)
