"""Arriving order files refresh exactly the days they touch."""

import datetime as dt

from pyspark.sql import functions as F

from checks import catalog
from martwright.plans import jobs, marts
from martwright.ranges import DateRange
from martwright.settings import Settings
from martwright.sources.core import CoreTables
from martwright.sources.sample import sample_core
from martwright.sources.store import MartStore
from martwright.streaming.refresh import refresh_touched, stream_refresh, touched_days
from tests.conftest import SMALL, rows, utc

CFG = Settings(clock=lambda: utc("2011-04-01 00:00:00"))


def test_late_file_changes_only_its_days(spark, tmp_path):
    """Two files arrive in two passes; after each the store equals a batch over what is there."""
    orders = sample_core(spark, SMALL).orders
    folder = str(tmp_path / "orders")
    late = F.col("timestamp") < F.lit("2010-10-20").cast("timestamp_ntz")

    def on_disk(name):
        return spark.read.schema(orders.schema).parquet(folder)

    def deliver(df):
        df.coalesce(1).write.mode("append").parquet(folder)
        env = jobs.Environment(CoreTables(on_disk), MartStore(spark, str(tmp_path / "s")), CFG)
        stream_refresh(
            spark, env, folder, orders.schema, str(tmp_path / "progress")
        ).awaitTermination()
        return env

    recent = orders.where(~late)
    env = deliver(recent)
    first = {r["date"]: r for r in rows(env.store.read("daily"))}
    assert set(first) == {r.date for r in touched_days(recent, CFG.zone).collect()}

    env = deliver(orders.where(late).limit(40))
    for name in ("daily", "provider_daily", "product_daily"):
        batch = marts.BUILDERS[name](env.core, catalog.FULL, CFG)
        if name == "daily":
            batch = batch.where("orders_created_count > 0")
        stored = env.store.read(name).drop("created_at", "updated_at")
        assert stored.exceptAll(batch).count() == 0 and batch.exceptAll(stored).count() == 0
    assert len(rows(env.store.read("daily"))) > len(first)


def test_pass_without_new_files_does_nothing(spark, tmp_path):
    env = catalog.new_environment(spark, SMALL)
    raw = spark.read.parquet(f"{SMALL}/orders.parquet").schema
    for _ in range(2):
        stream_refresh(
            spark, env, f"{SMALL}/orders*.parquet", raw, str(tmp_path / "p"), catalog.map_orders
        ).awaitTermination()
        total = env.store.read("daily").agg(F.sum("orders_created_count")).first()[0]
        assert total == 1500
    assert env.store.read("daily", DateRange.one_day(dt.date(2010, 11, 14))).count() == 1


def test_one_environment_sees_what_arrives(spark, tmp_path):
    """The same environment refreshes, gets more files of a known and of a new day, refreshes
    again by stream and by the rolling job, and equals the batch each time."""
    orders = sample_core(spark, SMALL).orders
    folder = str(tmp_path / "orders")
    core = sample_core(spark, SMALL)

    def fetch(name):
        if name == "orders":
            return spark.read.schema(orders.schema).parquet(folder)
        return getattr(core, name)

    env = jobs.Environment(CoreTables(fetch), MartStore(spark, str(tmp_path / "s")), CFG)
    day = F.to_date("timestamp")
    first = orders.where((day == "2011-03-10") & (F.col("order_id").cast("int") % 2 == 0))
    later = orders.where(
        ((day == "2011-03-10") & (F.col("order_id").cast("int") % 2 == 1)) | (day == "2011-03-20")
    )
    for df in (first, later):
        df.coalesce(1).write.mode("append").parquet(folder)
        stream_refresh(
            spark, env, folder, orders.schema, str(tmp_path / "p"), everything=True
        ).awaitTermination()
        now = env.core.reopened()
        for name in ("daily", "promo_daily"):
            want = marts.BUILDERS[name](now, catalog.FULL, CFG)
            days = [r.date for r in touched_days(now.orders, CFG.zone).collect()]
            want = want.where(F.col("date").isin(days))
            got = env.store.read(name).drop("created_at", "updated_at")
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    orders.where(day == "2011-03-25").coalesce(1).write.mode("append").parquet(folder)
    jobs.incremental_refresh(env, "last_30_days", dt.date(2011, 3, 30))
    total = env.store.read("daily").agg(F.sum("orders_created_count")).first()[0]
    assert total == env.core.reopened().orders.count()


def test_job_count_does_not_depend_on_the_days(spark, tmp_path):
    orders = sample_core(spark, SMALL).orders
    tracker = spark.sparkContext.statusTracker()

    def jobs_for(days, name):
        env = jobs.Environment(sample_core(spark, SMALL), MartStore(spark, str(tmp_path / name)), CFG)
        spark.sparkContext.setJobGroup(name, name)
        refresh_touched(env, orders.where(F.to_date("timestamp").isin(days)))
        return len(tracker.getJobIdsForGroup(name))

    few = jobs_for(["2011-01-03"], "few")
    many = jobs_for([f"2011-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in (3, 9, 15, 21, 27)], "many")
    assert many <= 1.5 * few


def _by_day(env, name="daily"):
    return {r["date"]: r for r in rows(env.store.read(name).drop("created_at", "updated_at"))}


def _mover(spark, tmp_path, versions):
    """An environment over order files of which the last version of each order counts."""
    folder = str(tmp_path / "orders")

    def fetch(name):
        if name != "orders":
            return getattr(sample_core(spark, SMALL), name)
        newest = F.max_by(F.struct("*"), "seen")
        files = spark.read.parquet(folder)
        return files.groupBy(F.coalesce("order_id", F.concat(F.lit("row "), "seen", F.uuid()))
                             .alias("k")).agg(newest.alias("o")).select("o.*")

    env = jobs.Environment(CoreTables(fetch), MartStore(spark, str(tmp_path / "s")), CFG)

    def deliver(df, number):
        df = df.withColumn("seen", F.lit(number))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream_refresh(
            spark, env, folder, df.schema, str(tmp_path / "p")
        ).awaitTermination()

    for number, df in enumerate(versions):
        deliver(df, number)
    return env, deliver


def test_a_moved_order_corrects_both_days_and_none_between(spark, tmp_path):
    orders = sample_core(spark, SMALL).orders
    day = F.to_date("timestamp")
    env, deliver = _mover(spark, tmp_path, [orders])
    before, parts = _by_day(env), env.store.version("daily").parts
    moved = orders.where((day == "2010-10-20") & F.col("order_id").isNotNull()).limit(1)
    key = moved.first().order_id
    deliver(orders.where(F.col("order_id") == key).withColumn(
        "timestamp", F.lit("2011-03-10 09:00:00").cast("timestamp_ntz")), 1)
    after = _by_day(env)
    changed = {d for d in after if after[d] != before.get(d)}
    local = cal_date(orders.where(F.col("order_id") == key))
    assert changed == {local, dt.date(2011, 3, 10)}
    assert after[local]["orders_created_count"] == before[local]["orders_created_count"] - 1
    now = env.store.version("daily").parts
    assert {m for m in now if now[m] != parts[m]} == {"2010-10-01", "2011-03-01"}
    # And back again: the state still knows both days.
    deliver(orders.where(F.col("order_id") == key), 2)
    assert _by_day(env) == before


def cal_date(df):
    return touched_days(df, CFG.zone).first().date


def test_orders_without_id_share_no_state(spark, tmp_path):
    orders = sample_core(spark, SMALL).orders.withColumn("order_id", F.lit(None).cast("string"))
    day = F.to_date("timestamp")
    env, deliver = _mover(spark, tmp_path, [orders.where(day == "2010-10-20")])
    stamp = env.store.read("daily").agg(F.max("updated_at")).first()[0]
    parts = env.store.version("daily").parts
    deliver(orders.where(day == "2011-03-20"), 1)
    assert env.store.version("daily").parts["2010-10-01"] == parts["2010-10-01"]
    assert stamp is not None and env.store.read("daily").count() >= 2


def test_scattered_days_are_the_only_ones_read(spark, tmp_path):
    from martwright.plans.marts import build_daily, build_promo_daily
    from martwright.ranges import MOST_PIECES, DaySet
    from martwright.sources import core as cs

    core = sample_core(spark, SMALL)
    target = str(tmp_path / "copy")
    cs.snapshot_core(
        lambda n: getattr(core, n) if n in cs.SCHEMAS else spark.range(1), target)
    stored = cs.read_core(spark, target)
    days = DaySet.of([dt.date(2010, 10, 20), dt.date(2011, 3, 10), dt.date(2011, 3, 11)])
    assert [(p.start, p.end) for p in days.pieces] == [
        (dt.date(2010, 10, 20),) * 2, (dt.date(2011, 3, 10), dt.date(2011, 3, 11))]
    built = build_daily(stored, days, CFG)
    files = built.inputFiles()
    folders = {f.split("timestamp_day=")[1][:10] for f in files}
    assert folders  # the plan's relation lists all; the scan opens the named days
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(timestamp_day" in plan or "timestamp_day" in (
        plan.split("PartitionFilters")[1][:400])
    whole = build_daily(core, catalog.FULL, CFG).where(F.col("date").isin(sorted(days.listed)))
    assert built.exceptAll(whole).count() == 0 and whole.exceptAll(built).count() == 0
    # Too many runs to state each: days are then told apart by their date.
    odd = DaySet.of([catalog.FULL.start + dt.timedelta(days=2 * i) for i in range(MOST_PIECES + 9)])
    assert len(odd.pieces) == MOST_PIECES and not odd.exact
    for build in (build_daily, build_promo_daily):
        got = build(stored, odd, CFG)
        want = build(core, catalog.FULL, CFG).where(F.col("date").isin(sorted(odd.listed)))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
