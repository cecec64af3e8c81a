"""One user, order or attempt with a third of all rows: results against brute force in Python,
and what reaches the shuffles."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martwright.plans import insights, marts, metrics, payments
from martwright.ranges import DateRange
from martwright.settings import Settings
from martwright.sources.core import CoreTables
from tests.conftest import rows

CFG = Settings()
JAN = DateRange(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
N = 6000


@pytest.fixture(scope="module")
def core(spark):
    """6,000 orders of which every third belongs to user 'hot', and 6,000 transactions of which
    every third belongs to order '0'; a third of those have no time of their own."""
    ids = spark.range(0, N, 1, 8)
    orders = ids.selectExpr(
        "string(id) AS order_id",
        "if(id % 3 = 0, 'hot', concat('u', id % 500)) AS user_id",
        "if(id % 4 < 3, 'paid', 'failed') AS status",
        "'stars' AS product_type",
        "if(id % 3 = 1, 'card', 'wallet') AS payment_provider",
        "CAST(id % 90 AS DECIMAL(14,2)) AS amount_rub",
        "CAST(NULL AS DECIMAL(15,2)) AS amount_rub_original",
        "CAST(1 AS DECIMAL(14,2)) AS cost_rub",
        "CAST(NULL AS DECIMAL(14,2)) AS profit_rub",
        "CAST(2 AS DECIMAL(14,4)) AS cost_per_star",
        "if(id % 3 = 0, 'HOT', concat('C', id % 40)) AS promo_code",
        "timestampadd(MINUTE, int(id * 7 % 43000), timestamp_ntz'2024-01-01 00:00:00')"
        " AS timestamp",
    )
    users = ids.where("id < 500").selectExpr(
        "concat('u', id) AS user_id", "CAST(NULL AS STRING) AS username",
        "if(id % 2 = 0, 'r', NULL) AS referrer_id",
        "timestamp_ntz'2024-01-03 00:00:00' AS created_at",
    ).unionByName(
        spark.range(1).selectExpr("'hot' AS user_id", "'H' AS username", "'r' AS referrer_id",
                                  "timestamp_ntz'2024-01-03 00:00:00' AS created_at")
    )
    transactions = ids.selectExpr(
        "string(id) AS id",
        "CASE id % 3 WHEN 0 THEN '0' WHEN 1 THEN string(id) END AS order_id",
        "'card' AS provider",
        "if(id % 2 = 0, concat('t', id), NULL) AS provider_txn_id",
        "if(id % 5 = 0, 'paid', 'pending') AS status",
        "if(id % 9 < 3, NULL, timestampadd(MINUTE, int(id % 40000),"
        " timestamp_ntz'2024-01-01 00:00:00')) AS created_at",
    )
    earnings = ids.selectExpr(
        "if(id % 3 = 0, '0', string(id)) AS order_id", "int(id % 5) AS stars",
        "timestampadd(MINUTE, int(id % 40000), timestamp_ntz'2024-01-01 00:00:00') AS created_at",
    )
    redemptions = ids.selectExpr("if(id % 3 = 0, 'HOT', concat('C', id % 40)) AS code",
                                 "timestamp_ntz'2024-01-09 00:00:00' AS created_at")
    held = {"orders": orders, "users": users, "payment_transactions": transactions,
            "referral_earnings": earnings, "promo_redemptions": redemptions}
    return CoreTables(lambda name: held[name])


@pytest.fixture(scope="module")
def plain(core):
    """The same tables as Python rows with local dates."""
    def local(ts):
        return (ts + dt.timedelta(hours=3)).date() if ts else None

    orders = [r.asDict() for r in core.orders.collect()]
    for o in orders:
        o["d"] = local(o["timestamp"])
    when = {o["order_id"]: o["d"] for o in orders}
    tx = [r.asDict() for r in core.payment_transactions.collect()]
    for t in tx:
        t["d"] = local(t["created_at"]) or when.get(t["order_id"])
    earned = [r.asDict() for r in core.referral_earnings.collect()]
    for e in earned:
        e["d"] = local(e["created_at"])
    return {"orders": orders, "tx": tx, "earned": earned}


def inside(d):
    return d is not None and JAN.start <= d <= JAN.end


def test_daily(core, plain):
    per_user = defaultdict(int)
    for o in plain["orders"]:
        if o["status"] == "paid":
            per_user[o["d"], o["user_id"]] += 1
    unique, repeat = defaultdict(int), defaultdict(int)
    for (d, _), n in per_user.items():
        unique[d] += 1
        repeat[d] += n >= 2
    for r in rows(marts.build_daily(core, JAN, CFG)):
        assert r["unique_buyers_count"] == unique[r["date"]]
        assert r["repeat_buyers_count"] == repeat[r["date"]]


def test_referral(core, plain):
    bonus, bought = defaultdict(D), defaultdict(int)
    for e in plain["earned"]:
        bonus[e["d"]] += 2 * e["stars"]
    for o in plain["orders"]:
        u = o["user_id"]
        if o["status"] == "paid" and (u == "hot" or int(u[1:]) % 2 == 0):
            bought[o["d"]] += 1
    for r in rows(marts.build_referral_daily(core, JAN, CFG)):
        assert r["referral_bonus_cost_rub"] == bonus[r["date"]]
        assert r["referred_orders_paid_count"] == bought[r["date"]]


def test_payment_views(core, plain):
    attempts, best = defaultdict(set), defaultdict(int)
    failing = defaultdict(set)
    for t in plain["tx"]:
        if not inside(t["d"]):
            continue
        key = f"card:{t['provider_txn_id']}" if t["provider_txn_id"] else (
            f"order:{t['order_id']}" if t["order_id"] else f"row:{t['id']}")
        attempts[t["d"]].add(key)
        best[key] = max(best[key], t["status"] == "paid")
        failing[t["status"]].add(key)
    got = rows(payments.payments_daily(core, JAN, CFG))
    assert {r["date"]: r["payment_attempts_count"] for r in got if r["payment_attempts_count"]} == {
        d: len(k) for d, k in attempts.items()
    }
    by_provider = {r["provider"]: r for r in rows(payments.payments_providers(core, JAN, CFG))}
    assert by_provider["card"]["payment_attempts_count"] == len(best)
    assert by_provider["card"]["payment_success_count"] == sum(best.values())
    lost = [k for k, won in best.items() if not won]
    assert rows(payments.payment_failures(core, JAN, CFG)) == [
        {"provider": "card", "status": "pending", "failures_count": len(lost)}
    ]


def test_referral_traffic(core, plain):
    owner = {o["order_id"]: o["user_id"] for o in plain["orders"]}
    events, orders = defaultdict(int), defaultdict(set)
    for t in plain["tx"]:
        u = owner.get(t["order_id"])
        if u and (u == "hot" or int(u[1:]) % 2 == 0):
            events[t["d"]] += 1
            orders[t["d"]].add(t["order_id"])
    for r in rows(payments.referrals(core, marts.derive_marts(core, JAN, CFG), JAN, CFG)):
        assert r["referred_payment_attempts_count"] == events[r["date"]]
        assert r["referred_payment_orders_count"] == len(orders[r["date"]])


def test_user_measures(core, plain):
    revenue = defaultdict(D)
    for o in plain["orders"]:
        if o["status"] == "paid" and inside(o["d"]):
            revenue[o["user_id"]] += o["amount_rub"]
    got = rows(metrics.users(core, JAN, CFG, limit=1000))
    assert {r["user_id"]: r["revenue_rub"] for r in got} == {
        u: float(revenue[u]) for u in (r["user_id"] for r in got)
    }
    assert got[0]["user_id"] == "hot"


def test_retention(core, plain):
    days = defaultdict(set)
    for o in plain["orders"]:
        if o["status"] == "paid":
            days[o["user_id"]].add(o["d"])
    base = [d for d in days.values() if inside(min(d))]
    kept = sum(any(0 < (x - min(d)).days <= 7 for x in d) for d in base)
    got = rows(insights.kpis(core, marts.derive_marts(core, JAN, CFG), JAN, CFG))[0]
    assert got["users_in_base"] == len(base)
    assert got["retention_d7_rate"] == round(kept / len(base), 4)


@pytest.mark.parametrize(
    ("grain", "key"),
    [
        (lambda c: marts.buyer_days(c, JAN, CFG), "user_id"),
        (lambda c: payments.attempt_grain(payments.payment_events(c, JAN, CFG)), "provider"),
    ],
)
def test_hot_keys_collapse_before_the_shuffle(core, grain, key):
    """A hot user is at most one row per task and day when it is shuffled."""
    collapsed = grain(core)
    assert "partial_" in collapsed._jdf.queryExecution().executedPlan().toString()
    if key == "user_id":
        hot = collapsed.where(F.col(key) == "hot").count()
        assert hot <= JAN.days < N / 3


def test_remaining_join_skew_is_split_at_run_time(spark, core):
    """Undated transactions of one order with distinct attempts cannot collapse; the join splits
    them over several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        joined = payments.payment_events(core, JAN, CFG)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    assert "SortMergeJoin(skew=true)" in plan
