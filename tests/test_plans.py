"""What the physical plans must and must not contain."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import catalog
from checks.catalog import QUERIES
from martwright.plans import marts, payments
from martwright.ranges import DateRange
from martwright.settings import Settings
from martwright.sources import core as cs
from martwright.sources.sample import sample_core
from tests.conftest import SMALL

CFG = Settings()
MARCH = DateRange(dt.date(2011, 3, 1), dt.date(2011, 3, 30))
EAGER = ("store_", "job_", "export_", "stream_", "snapshot_", "dq_issues", "dq_summary")
LAZY = sorted(n for n in QUERIES if not n.startswith(EAGER))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """Core tables in day folders, as a cluster would hold them."""
    return catalog._snapshot(spark, SMALL)


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_pairing_of_everything(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval",
                   "MapInPandas", "FlatMapGroups", "Expand"):
        assert banned not in plan, banned


@pytest.mark.parametrize("name", ["daily", "provider_daily", "product_daily", "promo_daily"])
def test_range_reaches_folders_and_files(stored, name):
    plan = plan_of(marts.BUILDERS[name](stored, MARCH, CFG))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans
    for scan in scans:
        assert "_day#" in scan.split("PartitionFilters")[1]
        assert "GreaterThanOrEqual" in scan and "LessThan" in scan


def test_scans_read_only_their_columns(stored):
    plan = plan_of(marts.build_daily(stored, MARCH, CFG))
    schemas = sorted(line.split("ReadSchema: ")[1] for line in plan.splitlines()
                     if "FileScan" in line)
    assert len(schemas) == 2
    assert not any("promo_code" in s or "order_id" in s or "payment_provider" in s
                   for s in schemas)
    buyers = [s for s in schemas if "user_id" in s]
    assert len(buyers) == 1 and "amount_rub" not in buyers[0]


def test_one_conversion_per_row(stored):
    """The range filter works on the stored instant, not on the converted date."""
    plan = plan_of(marts.build_provider_daily(stored, MARCH, CFG))
    filters = [line for line in plan.splitlines() if "Filter (" in line]
    assert filters and not any("from_utc" in f or "convert_timezone" in f for f in filters)


def test_only_undated_transactions_are_joined(stored):
    plan = plan_of(payments.payment_events(stored, MARCH, CFG))
    dated, joined = plan.split("Union")[1].split("Join", 1)
    assert "IsNull(created_at)" in joined and "IsNull(created_at)" not in dated
    assert "Exchange" not in dated


def test_cohorts_collapse_before_each_shuffle(stored):
    plan = plan_of(marts.build_cohort_weekly(stored, MARCH, CFG))
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 4


def test_first_purchase_history_is_cut_above(stored):
    plan = plan_of(marts.build_cohort_weekly(stored, MARCH, CFG))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "timestamp_day#" in scan.split("PartitionFilters")[1] and "LessThan" in scan


def test_daily_aggregates_are_partial_first(stored):
    plan = plan_of(marts.build_daily(stored, MARCH, CFG))
    assert plan.count("partial_") > 0
    assert plan.count("Exchange hashpartitioning") == 3


def test_no_window_over_a_single_partition(spark):
    for name in LAZY:
        plan = plan_of(QUERIES[name](spark, SMALL))
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Window [" in line:
                assert "SinglePartition" not in "\n".join(lines[i : i + 4]), name


def test_measured_size_decides_how_days_are_filled(spark):
    """No hint: frames of few days are broadcast, and none is once they exceed the threshold."""
    core = sample_core(spark, SMALL)

    def final_plan() -> str:
        df = marts.build_daily(core, MARCH, CFG)
        df.collect()
        return plan_of(df).split("Initial Plan")[0]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    short = final_plan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64")
    try:
        long = final_plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in short and "SortMergeJoin" not in short
    assert "BroadcastHashJoin" not in long and "SortMergeJoin" in long


def test_snapshot_has_day_folders(stored):
    assert set(cs.DAY_FOLDERS) == {n for n in cs.SCHEMAS
                                   if f"{cs.EVENT_TIME[n]}_day" in getattr(stored, n).columns}
    assert stored.orders.where(F.to_date("timestamp") != F.col("timestamp_day")).count() == 0


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_foreign_types_are_cast_and_ranges_pushed(spark, tmp_path, kind):
    """A database-shaped copy: wide numbers, bigint keys, instants with or without a zone."""
    orders = sample_core(spark, SMALL).orders
    moment = F.col("timestamp")
    if kind == "timestamp":
        moment = F.to_timestamp(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
    wide = orders.withColumns({
        "user_id": F.col("user_id").cast("bigint"), "order_id": F.col("order_id").cast("bigint"),
        "amount_rub": F.col("amount_rub").cast("decimal(38,18)"), "timestamp": moment,
    })
    wide.write.parquet(str(tmp_path / "orders"))
    core = cs.read_core(spark, str(tmp_path))
    built = marts.build_provider_daily(core, MARCH, CFG)
    want = marts.build_provider_daily(sample_core(spark, SMALL), MARCH, CFG)
    assert built.exceptAll(want).count() == 0 and want.exceptAll(built).count() == 0
    scans = [line for line in plan_of(built).splitlines() if "FileScan" in line]
    assert scans
    for scan in scans:
        pushed = scan.split("PushedFilters")[1]
        assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed

    def fetch(name):
        return wide if name == "orders" else getattr(sample_core(spark, SMALL), name, wide)

    target = str(tmp_path / "copy")
    cs.snapshot_core(fetch, target)
    again = cs.read_core(spark, target)
    assert dict(again.orders.dtypes)["amount_rub"] == "decimal(14,2)"
    copied = marts.build_provider_daily(again, MARCH, CFG)
    assert copied.exceptAll(want).count() == 0 and want.exceptAll(copied).count() == 0


def test_time_slices_cover_without_overlap(spark):
    parts = cs.time_slices("t", ["2011-01-01", "2011-02-01"], ["k % 2 = 0", "k % 2 = 1"])
    df = spark.sql(
        "SELECT id AS k, if(id % 5 = 0, NULL, timestampadd(DAY, int(id), timestamp_ntz'2010-12-01'))"
        " AS t FROM range(100)"
    )
    assert [sum(df.where(p).count() for p in parts), len(parts)] == [100, 5]


def test_history_is_reduced_before_it_is_shuffled(stored):
    """Funnel and referral traffic: the transactions (and orders) of all history meet the buckets of
    the range's keys where they are scanned, below the first exchange."""
    from martwright.plans import metrics

    plan = plan_of(metrics.funnel(stored, MARCH, CFG))
    paying = next(p for p in plan.split("Exchange hashpartitioning") if "payment_transactions" in p)
    assert "LeftSemi, BuildRight" in paying.split("payment_transactions")[0]
    plan = plan_of(payments._referred_transactions(stored, MARCH, CFG))
    assert plan.count("LeftSemi, BuildRight") >= 2
    assert "BroadcastNestedLoopJoin" not in plan


def test_shuffled_rows_grow_with_the_range(spark):
    """Of 50,000 orders' events only those of the one day's orders are left after the reducer."""
    from martwright.operators.frames import reduced

    tx = spark.range(200_000).selectExpr("string(id % 50000) AS order_id")
    day = spark.range(100).selectExpr("string(id * 7) AS order_id")
    assert reduced(tx, "order_id", day).count() < 2 * 100 * 4


def test_kept_purchases_spare_the_history(stored, spark):
    """With first purchases at hand the order scans open the range's day folders only."""
    from martwright.plans import insights

    firsts = spark.createDataFrame([], "user_id string, first_date date")
    for df in (marts.build_cohort_weekly(stored, MARCH, CFG, firsts),
               insights._buyer_history(stored, MARCH, CFG, firsts)):
        scans = [x for x in plan_of(df).splitlines() if "FileScan" in x and "/orders" in x]
        assert scans and all(
            "GreaterThanOrEqual" in x.split("PartitionFilters")[1].split("PushedFilters")[0]
            or ">= " in x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in scans)


def test_files_without_the_user_are_not_read(stored):
    """One user's orders: row groups that the Bloom filters and sorted statistics rule out."""
    from martwright.plans import metrics

    user = "85"
    own = stored.orders.where(F.col("user_id") == user)
    days = own.select("timestamp_day").distinct().count()
    df = metrics.user_orders(stored, user, catalog.FULL, CFG)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    node = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    todo, read = [node], None
    while todo:
        node = todo.pop()
        if "plan" in dir(node) and "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if "Scan parquet" in node.nodeName():
            read = node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert read is not None
    in_days = stored.orders.join(own.select("timestamp_day").distinct(), "timestamp_day").count()
    # Twice: once to find the ranges of the sort, once to sort.
    assert own.count() <= read <= 2 * in_days < 0.2 * stored.orders.count() and days > 1
