"""Hand cases for the rules that are easy to get wrong."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martwright.functions import calendar as cal
from martwright.functions import values as v
from martwright.plans import insights, marts, metrics, panel, payments, quality
from martwright.ranges import DateRange
from martwright.settings import Settings
from tests.conftest import order, rows, utc

CFG = Settings()
SEEN = utc("2024-01-31 06:00:00")
JAN = DateRange(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
MARTS = marts.MARTS


def day(n: int) -> dt.date:
    return dt.date(2024, 1, n)


def marts_of(core, rng=JAN):
    return marts.derive_marts(core, rng, CFG)


# --- calendar ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("stored", "local"),
    [
        ("2024-01-10 20:59:59", dt.date(2024, 1, 10)),  # +3
        ("2024-01-10 21:00:00", dt.date(2024, 1, 11)),
        ("2011-07-10 19:59:59", dt.date(2011, 7, 10)),  # +4
        ("2011-07-10 20:00:00", dt.date(2011, 7, 11)),
    ],
)
def test_business_day_edges(spark, tables, stored, local):
    core = tables(orders=[order("a", "u", stored, amount_rub=1)])
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            built = rows(marts.build_daily(core, DateRange.one_day(local), CFG))
            assert [(r["date"], r["orders_paid_count"]) for r in built] == [(local, 1)]
            other = local + dt.timedelta(days=1 if "59:59" in stored else -1)
            assert rows(marts.build_daily(core, DateRange.one_day(other), CFG))[0][
                "orders_paid_count"
            ] == 0
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_range_filter_agrees_with_converted_dates_in_odd_zones(spark):
    """Zones that skip or repeat midnight, and ones that do not, around their changes."""
    minutes = spark.range(0, 60 * 24 * 6, 1, 4)
    for zone, start in [
        ("America/St_Johns", dt.date(2006, 10, 27)),  # falls back across midnight
        ("America/Havana", dt.date(2023, 11, 3)),  # repeats the first hour of the day
        ("America/Sao_Paulo", dt.date(2018, 11, 2)),  # skips midnight
        ("Europe/Moscow", dt.date(2010, 10, 29)),
        ("Asia/Kathmandu", dt.date(2020, 1, 1)),
    ]:
        base = str(dt.datetime.combine(start, dt.time()))
        df = minutes.select(
            F.expr(f"timestampadd(MINUTE, int(id), timestamp_ntz'{base}')").alias("ts")
        )
        for n in range(1, 5):
            rng = DateRange.one_day(start + dt.timedelta(days=n))
            exact = df.where(rng.holds(cal.local_date(F.col("ts"), zone))).count()
            kept = cal.within(df, "ts", rng, zone)
            assert kept.count() == exact
            assert kept.where(~rng.holds(F.col("date"))).count() == 0
            upper = df.where(cal.local_date(F.col("ts"), zone) <= F.lit(rng.end)).count()
            assert cal.up_to(df, "ts", rng.end, zone).count() == upper


def test_both_zone_conversions_agree(spark):
    df = spark.range(0, 3000, 1, 4).select(
        F.expr("timestampadd(HOUR, int(id * 37), timestamp_ntz'2005-01-01 00:15:00')").alias("ts")
    )
    fast = {r[0]: r[1] for r in df.select("ts", cal.local_ts(F.col("ts"), CFG.zone)).collect()}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        slow = {r[0]: r[1] for r in df.select("ts", cal.local_ts(F.col("ts"), CFG.zone)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert fast == slow


# --- order money ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("cost", "product", "expected"),
    [
        (None, "gift", "60.00"),
        (0, "gift", "60.00"),
        (-5, "gift", "60.00"),
        (7, "gift", "7.00"),
        (None, "stars", "0.00"),
        (0, "stars", "0.00"),
        (-5, "stars", "-5.00"),
        (7, "stars", "7.00"),
        (None, "", "0.00"),
        (-5, None, "-5.00"),
    ],
)
def test_effective_cost(tables, cost, product, expected):
    core = tables(
        orders=[order("a", "u", "2024-01-05", cost_rub=cost, product_type=product, amount_rub=100)]
    )
    row = core.orders.select(
        v.effective_cost(CFG).alias("c"), v.gross_profit(CFG).alias("g")
    ).first()
    assert row.c == D(expected)
    assert row.g == D("100.00") - D(expected)


def test_recorded_profit_wins_over_gross(tables):
    core = tables(
        orders=[
            order("a", "u", "2024-01-05", amount_rub=100, cost_rub=30, profit_rub=5),
            order("b", "u", "2024-01-05", amount_rub=100, cost_rub=30),
            order("c", "u", "2024-01-05", cost_rub=30),
        ]
    )
    got = {
        r.order_id: r.p
        for r in core.orders.select("order_id", v.effective_profit(CFG).alias("p")).collect()
    }
    assert got == {"a": D("5.00"), "b": D("70.00"), "c": D("-30.00")}
    summary = rows(metrics.user_summary(core, "u", JAN, CFG))[0]
    assert summary["gross_profit_rub"] == 70 + 70 - 30


def test_averages_round_once(tables):
    """1/3 of 0.05 is 0.01666..; a mean of 2.345 rounds half up; NULL amounts do not count."""
    core = tables(
        orders=[
            order("a", "u", "2024-01-05", amount_rub="2.34"),
            order("b", "v", "2024-01-05", amount_rub="2.35"),
            order("c", "w", "2024-01-05"),
        ]
    )
    row = rows(marts.build_daily(core, DateRange.one_day(day(5)), CFG))[0]
    assert row["avg_check_rub"] == D("2.35")
    assert row["orders_paid_count"] == 3


# --- daily, provider, product --------------------------------------------------------------


def test_buyers_repeat_within_one_day_only(tables):
    core = tables(
        orders=[
            order("a", "u", "2024-01-05 10:00", amount_rub=1),
            order("b", "u", "2024-01-05 11:00", amount_rub=1),
            order("c", "u", "2024-01-06 10:00", amount_rub=1),
            order("d", "u", "2024-01-07 10:00", amount_rub=1),
            order("e", "w", "2024-01-07 10:00", status="failed", amount_rub=1),
            order("f", "w", "2024-01-07 11:00", status="cancelled", amount_rub=1),
        ]
    )
    by_day = {r["date"]: r for r in rows(marts.build_daily(core, JAN, CFG))}
    assert len(by_day) == 31
    assert [by_day[day(d)]["repeat_buyers_count"] for d in (5, 6, 7)] == [1, 0, 0]
    assert by_day[day(7)]["orders_created_count"] == 3
    assert by_day[day(7)]["orders_failed_count"] == 1
    assert by_day[day(7)]["orders_cancelled_count"] == 0
    assert by_day[day(7)]["pay_conversion_rate"] == D("0.3333")
    assert by_day[day(8)]["pay_conversion_rate"] == 0
    total = rows(metrics.summary(marts_of(core), JAN))[0]
    assert total["unique_buyers_count"] == 3
    assert total["repeat_purchase_rate"] == 0.3333


def test_null_users_are_one_repeat_buyer_but_no_unique_one(tables):
    core = tables(orders=[order(str(i), None, "2024-01-05", amount_rub=1) for i in range(3)])
    row = rows(marts.build_daily(core, DateRange.one_day(day(5)), CFG))[0]
    assert (row["unique_buyers_count"], row["repeat_buyers_count"]) == (0, 1)


def test_blank_labels_and_unpaid_groups(tables):
    core = tables(
        orders=[
            order("a", "u", "2024-01-05", payment_provider="", product_type=None, amount_rub=2),
            order("b", "u", "2024-01-05", payment_provider=None, product_type="", amount_rub=3),
            order("c", "u", "2024-01-05", status="created", payment_provider="card",
                  product_type="gift", amount_rub=9),
        ]
    )
    by_provider = {
        r["payment_provider"]: r for r in rows(marts.build_provider_daily(core, JAN, CFG))
    }
    assert by_provider["unknown"]["revenue_rub"] == D("5.00")
    assert by_provider["card"]["orders_created_count"] == 1
    by_product = {r["product_type"]: r for r in rows(marts.build_product_daily(core, JAN, CFG))}
    assert by_product["gift"]["orders_paid_count"] == 0
    assert by_product["gift"]["avg_check_rub"] == 0


def test_configured_statuses(tables):
    cfg = Settings(statuses={"paid": ["paid", "settled"], "failed": ["failed"]})
    core = tables(orders=[order("a", "u", "2024-01-05", status="settled", amount_rub=2)])
    assert rows(metrics.user_summary(core, "u", JAN, cfg))[0]["orders_paid_count"] == 1
    assert rows(metrics.user_summary(core, "u", JAN, CFG))[0]["orders_paid_count"] == 0


def test_shared_grains_give_the_same_marts(tables):
    core = tables(
        orders=[
            order(str(i), None if i % 7 == 0 else f"u{i % 4}", f"2024-01-{1 + i % 9:02d}",
                  status=("paid", "failed", "paid")[i % 3], amount_rub=i,
                  payment_provider=("card", "", "wallet")[i % 3],
                  product_type=("gift", None, "stars")[i % 2])
            for i in range(60)
        ]
    )
    mix = marts.sales_mix(core, JAN, CFG)
    buyers = marts.buyer_days(core, JAN, CFG)
    for build, alone in [
        (marts.build_daily(core, JAN, CFG, mix, buyers), marts.build_daily(core, JAN, CFG)),
        (marts.build_provider_daily(core, JAN, CFG, mix),
         marts.build_provider_daily(core, JAN, CFG)),
        (marts.build_product_daily(core, JAN, CFG, mix), marts.build_product_daily(core, JAN, CFG)),
    ]:
        assert sorted(map(str, rows(build))) == sorted(map(str, rows(alone)))


# --- promo and referral --------------------------------------------------------------------


def test_promo_codes(tables):
    core = tables(
        promo_redemptions=[
            {"code": "A", "created_at": utc("2024-01-05")},
            {"code": "A", "created_at": utc("2024-01-05")},
            {"code": "", "created_at": utc("2024-01-05")},
            {"code": None, "created_at": utc("2024-01-05")},
        ],
        orders=[
            order("a", "u", "2024-01-05", promo_code="A", amount_rub=90, amount_rub_original=100),
            order("b", "u", "2024-01-05", promo_code="B", amount_rub=50, profit_rub=7),
            order("c", "u", "2024-01-05", promo_code=None, amount_rub=50),
            order("d", "u", "2024-01-05", promo_code="B"),
            order("e", "u", "2024-01-05", promo_code="", amount_rub=4),
            order("f", "u", "2024-01-05", status="created", promo_code="C", amount_rub=4),
        ],
    )
    got = {r["promo_code"]: r for r in rows(marts.build_promo_daily(core, JAN, CFG))}
    assert set(got) == {"A", "B", ""}
    assert (got["A"]["redemptions_count"], got["A"]["paid_orders_count"]) == (2, 1)
    assert got["A"]["discount_total_rub"] == D("10.00")
    assert (got["B"]["redemptions_count"], got["B"]["paid_orders_count"]) == (0, 2)
    assert got["B"]["discount_total_rub"] == 0
    assert got["B"]["profit_after_discount_rub"] == D("7.00")
    assert (got[""]["redemptions_count"], got[""]["paid_orders_count"]) == (1, 1)


def _referral_core(tables):
    return tables(
        users=[
            {"user_id": "u", "referrer_id": "r", "created_at": utc("2024-01-04")},
            {"user_id": "e", "referrer_id": "", "created_at": utc("2024-01-04")},
            {"user_id": "n", "referrer_id": None, "created_at": utc("2024-01-04")},
        ],
        orders=[
            order("1", "u", "2024-01-05", amount_rub=100, profit_rub=10, cost_per_star=2),
            order("2", "e", "2024-01-05", amount_rub=50, profit_rub=5),
            order("3", "n", "2024-01-05", amount_rub=70, profit_rub=70, cost_per_star=1),
            order("4", None, "2024-01-05", amount_rub=70),
            order("5", "u", "2024-01-05", status="failed", amount_rub=70),
        ],
        referral_earnings=[
            {"order_id": "1", "stars": 3, "created_at": utc("2024-01-05")},
            {"order_id": "1", "stars": 1, "created_at": utc("2024-01-06")},
            {"order_id": "2", "stars": 9, "created_at": utc("2024-01-05")},
            {"order_id": "3", "stars": None, "created_at": utc("2024-01-05")},
            {"order_id": None, "stars": 9, "created_at": utc("2024-01-05")},
            {"order_id": "gone", "stars": 9, "created_at": utc("2024-01-05")},
        ],
        payment_transactions=[
            {"id": "t1", "order_id": "1", "created_at": utc("2024-01-05")},
            {"id": "t2", "order_id": "1", "created_at": None},
            {"id": "t3", "order_id": "1", "created_at": utc("2024-01-06")},
            {"id": "t4", "order_id": "3", "created_at": utc("2024-01-05")},
            {"id": "t5", "order_id": None, "created_at": utc("2024-01-05")},
        ],
    )


def test_referral_mart(tables):
    got = {r["date"]: r for r in rows(marts.build_referral_daily(_referral_core(tables), JAN, CFG))}
    assert got[day(4)]["new_referred_users_count"] == 2
    five = got[day(5)]
    assert (five["referred_buyers_count"], five["referred_orders_paid_count"]) == (2, 2)
    assert five["referral_bonus_cost_rub"] == D("6.00")
    assert five["referral_profit_rub"] == D("9.00")
    assert got[day(6)]["referral_profit_rub"] == D("-2.00")


def test_referral_traffic(tables):
    core = _referral_core(tables)
    got = {r["date"]: r for r in rows(payments.referrals(core, marts_of(core), JAN, CFG))}
    five = got[day(5)]
    assert five["referred_payment_attempts_count"] == 2
    assert five["referred_payment_orders_count"] == 1
    assert five["referred_orders_failed_count"] == 1
    assert five["referred_attempt_to_paid_rate"] == 1.0
    assert five["referral_net_after_bonus_rub"] == 144.0
    assert got[day(6)]["referred_payment_attempts_count"] == 1


# --- cohorts -------------------------------------------------------------------------------


def test_cohort_ages_and_null_user(tables):
    core = tables(
        orders=[
            order("1", "u", "2024-01-01", amount_rub=10),
            order("2", "u", "2024-01-02", amount_rub=10),
            order("3", "u", "2024-01-22", amount_rub=5),  # age 3
            order("4", "u", "2024-04-01", amount_rub=5),  # age 13, beyond the last age
            order("5", None, "2024-01-03", amount_rub=99),
            order("6", "w", "2023-12-25", amount_rub=1),
            order("7", "w", "2024-01-01", amount_rub=1),
        ]
    )
    got = rows(marts.build_cohort_weekly(core, DateRange(day(3), day(9)), CFG))
    assert [(r["cohort_week"], r["age_week"]) for r in got] == [(day(1), 0), (day(1), 3)]
    assert got[0]["users_count"] == 2
    assert got[0]["repeat_buyers_count"] == 1
    assert got[0]["retention_rate"] == D("0.5")
    assert [r["period_revenue_rub"] for r in got] == [D("20"), D("5")]
    assert [r["cumulative_revenue_rub"] for r in got] == [D("20"), D("25")]


def test_cohort_of_null_users_only_has_no_row(tables):
    core = tables(orders=[order("1", None, "2024-01-03", amount_rub=9)])
    assert rows(marts.build_cohort_weekly(core, JAN, CFG)) == []


# --- payments ------------------------------------------------------------------------------


def test_payment_attempts(tables):
    def tx(id_, order_id=None, provider="card", txn=None, status="pending", at="2024-01-05"):
        return {"id": id_, "order_id": order_id, "provider": provider, "provider_txn_id": txn,
                "status": status, "created_at": at and utc(at)}

    core = tables(
        orders=[order("o1", "u", "2024-01-07", amount_rub=5, payment_provider="platega_status")],
        payment_transactions=[
            tx("1", "o1", "platega", "x", "pending"),
            tx("2", "o1", "platega_status", "x", "CONFIRMED"),  # same attempt, other feed
            tx("3", "o1", "platega", "x", "pending", "2024-01-06"),  # next day
            tx("4", "o1", "card", "", None),  # order identity, NULL status
            tx("5", None, "", None, ""),  # row identity
            tx("6", "o1", "card", None, "canceled", None),  # day of its order
            tx("7", None, "card", "y", "paid", None),  # no day at all
            tx("8", "gone", "card", "y", "paid", None),
        ],
    )
    daily = {r["date"]: r for r in rows(payments.payments_daily(core, JAN, CFG))}
    counts = [
        tuple(daily[day(d)][c] for c in payments.ATTEMPT_COUNTS) for d in (5, 6, 7)
    ]
    assert counts == [(3, 1, 2, 4), (1, 0, 1, 1), (1, 0, 1, 1)]
    by_provider = {r["provider"]: r for r in rows(payments.payments_providers(core, JAN, CFG))}
    assert by_provider["platega"]["payment_attempts_count"] == 1
    assert by_provider["platega"]["payment_success_count"] == 1
    assert by_provider["platega"]["orders_created_count"] == 0
    assert by_provider["platega_status"]["orders_created_count"] == 1
    assert by_provider["card"]["payment_attempts_count"] == 1
    failures = {(r["provider"], r["status"]): r["failures_count"]
                for r in rows(payments.payment_failures(core, JAN, CFG))}
    assert failures == {("card", "unknown"): 1, ("card", "canceled"): 1, ("unknown", "unknown"): 1}
    parts = payments.payments(core, JAN, CFG)
    assert rows(parts["daily"]) == rows(payments.payments_daily(core, JAN, CFG))
    assert rows(parts["providers"]) == rows(payments.payments_providers(core, JAN, CFG))
    assert rows(parts["failure_reasons"]) == rows(payments.payment_failures(core, JAN, CFG))
    assert rows(parts["summary"])[0]["payment_success_rate"] == 0.2


def test_funnel_counts_an_order_once(tables):
    core = tables(
        orders=[order("o1", "u", "2024-01-05"), order("o2", "u", "2024-01-05", status="created"),
                order("o3", None, "2024-01-05", status="created")],
        payment_transactions=[{"id": str(i), "order_id": "o1"} for i in range(5)]
        + [{"id": "n", "order_id": None}],
    )
    row = rows(metrics.funnel(core, DateRange.one_day(day(5)), CFG))[0]
    assert (row["app_open_count"], row["product_view_count"], row["checkout_start_count"]) == (
        1, 3, 1,
    )
    assert row["open_to_checkout_rate"] == row["checkout_to_created_rate"] == 0.3333


# --- key figures and unusual days ----------------------------------------------------------


def test_retention_and_value(tables):
    core = tables(
        orders=[
            order("1", "a", "2024-01-02", amount_rub=10),
            order("2", "a", "2024-01-02", amount_rub=10),  # same day: not retained
            order("3", "b", "2024-01-02", amount_rub=10),
            order("4", "b", "2024-01-09", amount_rub=30),  # day 7
            order("5", "c", "2024-01-02", amount_rub=10),
            order("6", "c", "2024-02-01", amount_rub=20),  # day 30, after the range
            order("7", "d", "2023-12-01", amount_rub=10),  # first purchase before the range
            order("8", "d", "2024-01-03", amount_rub=40),
            order("9", None, "2024-01-03", amount_rub=70),
        ]
    )
    got = rows(insights.kpis(core, marts_of(core), JAN, CFG))[0]
    assert got["users_in_base"] == 3
    assert got["retention_d7_rate"] == 0.3333
    assert got["retention_d30_rate"] == 0.6667
    assert got["ltv_30d_proxy_rub"] == 15.0  # 90 over six order rows, not three users
    assert got["repeat_revenue_share"] == round(70 / 110, 4)


def test_constant_series_has_no_anomalies(tables):
    core = tables(orders=[order(str(i), "u", f"2024-01-{i:02d}", amount_rub=5)
                          for i in range(1, 32)])
    assert rows(insights.anomalies(marts_of(core), JAN)) == []


def test_one_spike_is_found(tables):
    orders = [order(str(i), "u", f"2024-01-{i:02d}", amount_rub=5) for i in range(1, 32)]
    orders[9]["amount_rub"] = D("500")
    got = rows(insights.anomalies(marts_of(tables(orders=orders)), JAN))
    assert [(r["date"], r["metric"], r["value"]) for r in got] == [(day(10), "revenue_rub", 500.0)]
    assert got[0]["z_score"] == round((30**0.5), 2)


# --- summary, users, panel -----------------------------------------------------------------


def test_summary_of_nothing(tables):
    got = rows(metrics.summary(marts_of(tables()), JAN))[0]
    assert got["top_provider"] is None and got["top_product_revenue_rub"] is None
    assert got["avg_check_rub"] == 0.0 and got["orders_created_count"] == 0


def test_summary_of_reversed_range_is_empty(tables):
    core = tables(orders=[order("1", "u", "2024-01-05", amount_rub=5)])
    backwards = DateRange(day(20), day(2), ordered=False)
    assert rows(metrics.summary(marts_of(core), backwards))[0]["orders_created_count"] == 0


def test_user_list(tables):
    core = tables(
        users=[
            {"user_id": "u1", "username": "Ann_B", "referrer_id": "",
             "created_at": utc("2024-01-01 21:30")},
            {"user_id": "u2", "username": None, "created_at": utc("2024-01-01")},
            {"user_id": "x3", "username": "annie", "created_at": utc("2024-01-01")},
        ],
        orders=[
            order("1", "u1", "2023-05-05", amount_rub=5),
            order("2", "u1", "2024-01-05", amount_rub=7, cost_rub=2),
            order("3", "u1", "2024-01-06", status="created", amount_rub=100),
            order("4", "ghost", "2024-01-06", amount_rub=100),
        ],
    )
    got = {r["user_id"]: r for r in rows(metrics.users(core, JAN, CFG))}
    assert list(got) == ["u1", "u2", "x3"]
    one = got["u1"]
    assert (one["orders_created_count"], one["orders_paid_count"]) == (2, 1)
    assert (one["revenue_rub"], one["gross_profit_rub"]) == (7.0, 5.0)
    assert one["first_paid_date"] == dt.date(2023, 5, 5) and one["last_paid_date"] == day(5)
    assert one["referrer_id"] == "-" and one["user_created_date"] == day(2)
    assert got["u2"]["username"] == "-" and got["u2"]["revenue_rub"] == 0.0

    def found(text, limit=None):
        return [r["user_id"] for r in rows(metrics.users(core, JAN, CFG, text, limit))]

    assert found(" ANN ") == ["u1", "x3"]
    assert found("n_b") == ["u1"]
    assert found("U_") == ["u1", "u2"]
    assert found("", 1) == ["u1"]
    assert found("a\\b") == []


def test_user_details(tables):
    core = tables(users=[{"user_id": "u", "created_at": utc("2024-01-01")}])
    assert rows(metrics.user_details(core, "u", JAN, CFG)["profile"])[0]["username"] == "-"
    with pytest.raises(LookupError, match="User not found"):
        metrics.user_details(core, "nobody", JAN, CFG)
    with pytest.raises(ValueError, match="user_id is required"):
        metrics.user_details(core, " ", JAN, CFG)


def test_day_orders_are_the_latest_300_with_names(tables):
    core = tables(
        users=[{"user_id": "u", "username": "Ann", "created_at": utc("2024-01-01")}],
        orders=[
            order(f"{i:03d}", "u" if i % 2 else None, f"2024-01-05 {i // 60:02d}:{i % 60:02d}")
            for i in range(350)
        ],
    )
    everything = rows(metrics.day_orders(core, day(5), CFG))
    assert [r["order_id"] for r in everything] == [f"{i:03d}" for i in range(349, -1, -1)]
    got = rows(metrics.day_orders(core, day(5), CFG, 300))
    assert [r["order_id"] for r in got] == [f"{i:03d}" for i in range(349, 49, -1)]
    assert got == everything[:300]
    assert {(r["user_id"], r["username"]) for r in got} == {("u", "Ann"), (None, "-")}


def _series(spark, pairs):
    return spark.createDataFrame(pairs, "date date, x bigint")


@pytest.mark.parametrize(
    ("before", "expected"),
    [
        ([1, 2, 3], [1, 2, 3]),
        ([9, 1, 2, 3], [1, 2, 3]),
        ([2, 3], [0, 2, 3]),
        ([], [0, 0, 0]),
    ],
)
def test_series_align_from_their_last_point(spark, before, expected):
    from martwright.operators.frames import align_from_end

    now = _series(spark, [(day(20 + i), 10) for i in range(3)])
    old = _series(spark, [(day(2 * i + 1), x) for i, x in enumerate(before)])
    got = sorted(rows(align_from_end(now, old, "x")), key=lambda r: r["date"])
    assert [r["previous_value"] for r in got] == expected
    assert [r["difference"] for r in got] == [10 - x for x in expected]


def test_cohort_matrix_takes_the_ages_present(spark):
    cohorts = spark.createDataFrame(
        [(day(1), 0, D("1")), (day(1), 4, D("0.25")), (day(8), 0, D("1"))],
        "cohort_week date, age_week int, retention_rate decimal(8,4)",
    )
    got = rows(panel.cohort_matrix(cohorts))
    assert [(r["cohort_week"], r["age_0"], r["age_4"]) for r in got] == [
        (day(8), 1.0, 0.0), (day(1), 1.0, 0.25),
    ]


def test_cohort_cells_take_the_first_ages_present(spark):
    schema = "cohort_week date, age_week int, retention_rate decimal(8,4)"
    cohorts = spark.createDataFrame(
        [(day(1 + w), 2 * a, D("0.5")) for w in (0, 7) for a in range(5) if (w, a) != (7, 1)], schema)
    got = rows(panel.cohort_cells(cohorts, ages=3, weeks=2))
    assert [(r["cohort_week"].day, r["place"], r["age_week"], r["retention_rate"]) for r in got] == [
        (8, 0, 0, 0.5), (8, 1, 2, 0.0), (8, 2, 4, 0.5), (1, 0, 0, 0.5), (1, 1, 2, 0.5), (1, 2, 4, 0.5),
    ]
    assert panel.cohort_matrix(cohorts).columns == ["cohort_week", *[f"age_{a}" for a in (0, 2, 4, 6, 8)]]
    none = spark.createDataFrame([], schema)
    assert rows(panel.cohort_cells(none)) == [] and rows(panel.cohort_matrix(none)) == []


def test_reducer_keeps_all_wanted_keys_and_few_others(spark):
    from martwright.operators.frames import reduced

    wide = spark.range(200_000).selectExpr("string(id) AS k").union(spark.sql("SELECT NULL"))
    wanted = spark.range(0, 200_000, 97).selectExpr("string(id) AS k").union(spark.sql("SELECT NULL"))
    left = reduced(wide, "k", wanted)
    assert left.join(wanted, "k", "left_semi").count() == wanted.count() - 1
    assert left.count() < 1.5 * wanted.count()
    assert reduced(wide, "k", wanted.limit(0)).isEmpty()


def test_hourly_matrix_is_dense(tables):
    empty = panel.hourly_matrix(insights.hourly_heatmap(tables(), JAN, CFG))
    got = rows(empty)
    assert len(got) == 168 and {r["intensity"] for r in got} == {0.0}
    assert (got[0]["iso_dow"], got[0]["hour"], got[-1]["iso_dow"], got[-1]["hour"]) == (1, 0, 7, 23)


# --- quality -------------------------------------------------------------------------------


def test_checks_find_nothing_on_sound_marts(tables):
    core = tables(orders=[order("1", "u", "2024-01-05", amount_rub=5)])
    assert rows(quality.find_issues(core, marts.build_daily(core, JAN, CFG), JAN, CFG, SEEN)) == []


def test_negative_report_has_every_bad_day_and_ignores_the_range(spark, tables):
    daily = marts.build_daily(tables(), DateRange(dt.date(2023, 1, 1), day(31)), CFG)
    bad = daily.withColumn("revenue_rub", F.lit(D("-2.50")).cast("decimal(14,2)"))
    assert len(rows(quality.negative_values(bad, SEEN))) == 396
    got = rows(quality.negative_values(bad, SEEN, 100))
    assert len(got) == 100
    assert got[0]["message"] == "Suspicious values on 2023-01-01: revenue=-2.5, profit=0.0"
    assert got[0]["meta"] == '{"date":"2023-01-01","revenue_rub":"-2.5","profit_rub":"0.0"}'
