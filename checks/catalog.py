"""Every operator as a query over the supplied tables, with the fixed parameters of FIXTURES.md."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions import attempts as att
from martwright.functions import calendar as cal
from martwright.functions import values as v
from martwright.operators.frames import clamp_limit
from martwright.operators.workdir import materialize, new_folder
from martwright.plans import insights, jobs, marts, metrics, panel, payments, purchases, quality
from martwright.plans.marts import MARTS, Marts, derive_marts
from martwright.ranges import DateRange
from martwright.settings import Settings
from martwright.sources import core as core_source
from martwright.sources import store as st
from martwright.sources.core import CoreTables
from martwright.sources.sample import map_orders, sample_core
from martwright.streaming.deltas import stream_deltas
from martwright.streaming.refresh import stream_refresh

SEEN = dt.datetime(2011, 3, 31, 6, 0)
LATER = dt.datetime(2011, 3, 31, 7, 0)
CFG = Settings(clock=lambda: SEEN)
AS_OF = dt.date(2011, 3, 30)
FULL = DateRange(dt.date(2010, 10, 1), AS_OF)
RECENT = DateRange.last(30, AS_OF)
DAY = dt.date(2010, 11, 14)
USER = "85"
SEARCH = "9"
NAME_SEARCH = "TOMER#0000_00_5"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def on_core(name: str, fn: Callable[[CoreTables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(sample_core(spark, sf_dir))


def on_marts(name: str, fn: Callable[[CoreTables, Marts], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        core = sample_core(spark, sf_dir)
        return fn(core, derive_marts(core, FULL, CFG))

    QUERIES[name] = run


# --- sources and row expressions -----------------------------------------------------------

for _table in core_source.SCHEMAS:
    on_core(f"core_{_table}", lambda core, t=_table: getattr(core, t))


@query("x_order_values")
def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = cal.local_ts(F.col("timestamp"), CFG.zone)
    return sample_core(spark, sf_dir).orders.select(
        "order_id",
        cal.local_date(F.col("timestamp"), CFG.zone).alias("local_date"),
        wall.alias("timestamp_msk"),
        cal.week_start(wall.cast("date")).alias("week_start"),
        cal.iso_weekday(wall).alias("iso_dow"),
        cal.hour_of(wall).alias("hour"),
        v.or_unknown(F.col("payment_provider")).alias("payment_provider"),
        v.or_unknown(F.col("product_type")).alias("product_type"),
        v.effective_cost(CFG).alias("effective_cost"),
        v.effective_profit(CFG).alias("effective_profit"),
        v.gross_profit(CFG).alias("gross_profit"),
        v.promo_discount().alias("discount"),
    )


@query("x_payment_keys")
def payment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_core(spark, sf_dir).payment_transactions.select(
        "id",
        att.provider_name(CFG).alias("provider"),
        v.or_unknown(F.col("status")).alias("status"),
        att.attempt_key(CFG).alias("tx_key"),
        att.is_success(CFG).alias("is_success"),
        cal.local_date(F.col("created_at"), CFG.zone).alias("own_date"),
    )


@query("x_bonus_cost")
def bonus_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = sample_core(spark, sf_dir)
    return core.referral_earnings.join(
        core.orders.select("order_id", "cost_per_star"), "order_id", "left"
    ).select("order_id", "stars", v.bonus_cost().cast("decimal(20,4)").alias("bonus"))


# --- marts and mart reads ------------------------------------------------------------------

for _mart, _build in marts.BUILDERS.items():
    on_core(f"mart_{_mart}", lambda core, b=_build: b(core, FULL, CFG))

on_marts("q_daily", lambda core, m: metrics.daily(m, RECENT))
on_marts("q_providers", lambda core, m: metrics.providers(m, RECENT))
on_marts("q_products", lambda core, m: metrics.products(m, RECENT))
on_marts("q_promos", lambda core, m: metrics.promos(m, RECENT))
on_marts("q_promos_one_code", lambda core, m: metrics.promos(m, FULL, "PROMO2"))
on_marts("q_cohorts", lambda core, m: metrics.cohorts(m, metrics.default_cohort_range(AS_OF)))
on_marts("q_cohorts_one_age", lambda core, m: metrics.cohorts(m, FULL.weeks(), 1))
on_marts("q_summary", lambda core, m: metrics.summary(m, FULL))
on_marts("q_top_provider", lambda core, m: metrics.top_provider(m, FULL))
on_marts("q_top_product", lambda core, m: metrics.top_product(m, FULL))

# --- live queries --------------------------------------------------------------------------

on_marts("q_day_breakdown", lambda core, m: metrics.day_breakdown(core, m, DAY, CFG))
on_core("q_day_buyers", lambda core: metrics.day_buyers(core, DAY, CFG))
on_core("q_day_orders", lambda core: metrics.day_orders(core, DAY, CFG, 300))
on_core("q_day_orders_all", lambda core: metrics.day_orders(core, DAY, CFG))
on_core("q_funnel", lambda core: metrics.funnel(core, FULL, CFG))
on_core("q_payments_daily", lambda core: payments.payments_daily(core, FULL, CFG))
on_core("q_payments_providers", lambda core: payments.payments_providers(core, FULL, CFG))
on_core("q_payment_failures", lambda core: payments.payment_failures(core, FULL, CFG, limit=50))
on_core("q_payment_failures_all", lambda core: payments.payment_failures(core, FULL, CFG))
on_core(
    "q_payments_summary",
    lambda core: payments.payments_summary(payments.payments_daily(core, FULL, CFG)),
)
on_marts("q_referrals", lambda core, m: payments.referrals(core, m, FULL, CFG))
on_marts(
    "q_referrals_totals",
    lambda core, m: payments.referrals_totals(payments.referrals(core, m, FULL, CFG)),
)
on_marts("q_kpis", lambda core, m: insights.kpis(core, m, FULL, CFG))
on_marts("q_anomalies", lambda core, m: insights.anomalies(m, FULL, 30))
on_marts("q_anomalies_all", lambda core, m: insights.anomalies(m, FULL))
on_core("q_hourly_heatmap", lambda core: insights.hourly_heatmap(core, FULL, CFG))
on_core("q_users", lambda core: metrics.users(core, FULL, CFG, limit=clamp_limit(None)))
on_core("q_users_all", lambda core: metrics.users(core, FULL, CFG))
on_core("q_users_search", lambda core: metrics.users(core, FULL, CFG, SEARCH, 300))


@query("q_users_search_index")
def users_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = sample_core(spark, sf_dir)
    index = metrics.index_users(core, new_folder(spark, "users_index"), rows_per_part=200)
    return metrics.users(core, FULL, CFG, NAME_SEARCH, None, index)


on_core("q_user_profile", lambda core: metrics.user_profile(core, USER, CFG))
on_core("q_user_summary", lambda core: metrics.user_summary(core, USER, FULL, CFG))
on_core("q_user_orders", lambda core: metrics.user_orders(core, USER, FULL, CFG, 300))
on_core("q_user_orders_all", lambda core: metrics.user_orders(core, USER, FULL, CFG))

# --- quality -------------------------------------------------------------------------------


def damaged_daily(m: Marts) -> DataFrame:
    """The daily mart with one day gone, one negative revenue and one paid count too high."""
    date = F.col("date")
    wrong_revenue = date == F.lit(dt.date(2010, 12, 1))
    extra = F.when(date == F.lit(dt.date(2010, 12, 2)), 1).otherwise(0)
    return m.daily.where(date != F.lit(DAY)).withColumns(
        {
            "revenue_rub": F.when(wrong_revenue, F.lit(Decimal("-1.00"))).otherwise(
                F.col("revenue_rub")
            ),
            "orders_paid_count": F.col("orders_paid_count") + extra,
        }
    )


def _issues(core: CoreTables, m: Marts) -> DataFrame:
    return quality.find_issues(core, damaged_daily(m), FULL, CFG, SEEN)


on_marts("dq_missing_days", lambda core, m: quality.missing_days(damaged_daily(m), FULL, SEEN))
on_marts("dq_negative_values", lambda core, m: quality.negative_values(damaged_daily(m), SEEN))
on_marts(
    "dq_negative_values_all",
    lambda core, m: quality.negative_values(
        m.daily.withColumn("revenue_rub", -F.col("revenue_rub") - 1), SEEN
    ),
)
on_marts(
    "dq_paid_mismatch",
    lambda core, m: quality.paid_mismatch(core, damaged_daily(m), FULL, CFG, SEEN),
)
on_marts("dq_run", _issues)


@query("dq_issues")
def issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.list_issues(_stored_issues(spark, sf_dir), limit=clamp_limit(None))


@query("dq_summary")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issues_summary(_stored_issues(spark, sf_dir))


def _stored_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = sample_core(spark, sf_dir)
    store = st.MartStore(spark, new_folder(spark, "issues"))
    store.append_issues(_issues(core, derive_marts(core, FULL, CFG)))
    return store.issues()


# --- store, jobs, exports, stream ----------------------------------------------------------

_FILLED: dict[tuple[str, str], jobs.Environment] = {}


def new_environment(spark: SparkSession, sf_dir: str) -> jobs.Environment:
    store = st.MartStore(spark, new_folder(spark, "store"))
    return jobs.Environment(sample_core(spark, sf_dir), store, CFG)


def filled(spark: SparkSession, sf_dir: str) -> jobs.Environment:
    """A store after the full backfill; made once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILLED:
        env = new_environment(spark, sf_dir)
        jobs.backfill_full(env, FULL)
        _FILLED[key] = env
    return _FILLED[key]


for _mart in MARTS:
    QUERIES[f"store_{_mart}"] = lambda spark, sf_dir, n=_mart: getattr(
        filled(spark, sf_dir).store.marts(FULL), n
    )


@query("store_range_read")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir).store.marts(RECENT).provider_daily


@query("store_upsert_audit")
def upsert_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping upserts: the second moves ``updated_at`` only where it has rows."""
    env = new_environment(spark, sf_dir)
    first = DateRange(FULL.start, dt.date(2010, 12, 31))
    second = DateRange(dt.date(2010, 12, 15), FULL.end)
    for rng, at in ((first, SEEN), (second, LATER)):
        rows = marts.build_provider_daily(env.core, rng, CFG)
        env.store.upsert("provider_daily", rows, rng, at)
    return env.store.read("provider_daily").select(
        "date", "payment_provider", "orders_created_count", "created_at", "updated_at"
    )


@query("job_runs")
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.list_runs(filled(spark, sf_dir).store.runs(), status="success").select(
        "job_name", "range_start", "range_end", "status", "rows_written"
    )


@query("job_runs_summary")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.runs_summary(filled(spark, sf_dir).store.runs(), SEEN)


@query("job_last_success")
def last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.last_success(filled(spark, sf_dir).store.runs(), jobs.DAILY_JOB)


@query("job_incremental_refresh")
def rolling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = new_environment(spark, sf_dir)
    for mode in ("today", "last_3_days", "last_30_days"):
        jobs.incremental_refresh(env, mode, AS_OF)
    return env.store.marts().daily


@query("job_incremental_cohorts")
def rolling_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = new_environment(spark, sf_dir)
    jobs.incremental_refresh(env, "last_30_days", AS_OF)
    return env.store.marts().cohort_weekly


def _kept_buyers(spark: SparkSession, sf_dir: str) -> jobs.Environment:
    """A store that keeps purchases: built once, then two of its months made anew."""
    env = new_environment(spark, sf_dir)
    jobs.backfill_buyers(env, FULL)
    jobs.refresh_buyers(env, DateRange(dt.date(2010, 12, 20), dt.date(2011, 1, 5)))
    return env


@query("store_buyer_months")
def buyer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_buyers(spark, sf_dir).store.buyer_months()


@query("q_purchases")
def kept_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases.purchases(_kept_buyers(spark, sf_dir).store.buyer_months())


@query("job_cohorts_from_buyers")
def cohorts_from_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort job where purchases are kept: orders before the range are not read."""
    env = _kept_buyers(spark, sf_dir)
    jobs.backfill_cohort(env, FULL)
    return env.store.marts(FULL).cohort_weekly


@query("q_kpis_from_buyers")
def kpis_from_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = _kept_buyers(spark, sf_dir)
    firsts = purchases.purchases(env.store.buyer_months())
    return insights.kpis(env.core, derive_marts(env.core, FULL, CFG), FULL, CFG, firsts)


@query("job_referral_backfill")
def referral_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = new_environment(spark, sf_dir)
    jobs.backfill_referral(env, FULL)
    return env.store.marts().referral_daily


@query("export_csv_promos")
def csv_promos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promo mart written as CSV and read back."""
    store = filled(spark, sf_dir).store
    path = store.export_csv("promos", FULL, new_folder(spark, "csv"))
    schema = f"{MARTS['promo_daily'].ddl}, {st.AUDIT}"
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.drop("created_at", "updated_at")


def _json_round_trip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A query part written as JSON lines and read back."""
    folder = new_folder(spark, "json")
    st.write_documents({"part": df}, folder)
    return spark.read.schema(df.schema).json(f"{folder}/part")


@query("export_json_summary")
def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_round_trip(spark, metrics.summary(filled(spark, sf_dir).store.marts(FULL), FULL))


@query("export_json_referrals")
def json_referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = filled(spark, sf_dir)
    items = payments.referrals(env.core, env.store.marts(FULL), FULL, CFG)
    return _json_round_trip(spark, items)


@query("export_json_payments")
def json_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments document (range, summary, lists) written as one JSON file and read back: every
    row of its three lists beside the head of the document."""
    core = sample_core(spark, sf_dir)
    parts = payments.payments(core, FULL, CFG, materialize)
    path = f"{new_folder(spark, 'document')}.json"
    st.write_document(path, {"from": FULL.start, "to": FULL.end, **parts}, ("summary",))

    def nested(name: str) -> str:
        fields = parts[name].schema.simpleString()
        return fields if name == "summary" else f"array<{fields}>"

    schema = ", ".join(["`from` string", "`to` string", *[f"{n} {nested(n)}" for n in parts]])
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    def rows_of(name: str, label: str, detail: str | None, n: str) -> DataFrame:
        inside = whole.select("from", "to", F.inline(F.array(name) if name == "summary" else name))
        return inside.select(
            "from", "to", F.lit(name).alias("list"), F.expr(label).cast("string").alias("label"),
            F.expr(detail or "NULL").cast("string").alias("detail"), F.col(n).alias("n"),
        )

    attempts = "payment_attempts_count"
    return (
        rows_of("daily", "date", None, attempts)
        .union(rows_of("providers", "provider", None, attempts))
        .union(rows_of("failure_reasons", "provider", "status", "failures_count"))
        .union(rows_of("summary", "'all'", None, attempts))
    )


@query("stream_refresh")
def streamed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily mart as left by the file stream over the order files."""
    env = new_environment(spark, sf_dir)
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    stream_refresh(
        spark, env, f"{sf_dir}/orders*.parquet", raw, new_folder(spark, "stream"), map_orders
    ).awaitTermination()
    return env.store.marts().daily


@query("stream_deltas")
def added_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily mart from sums of what arrives: the orders as several files, one a micro-batch."""
    env = new_environment(spark, sf_dir)
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files = new_folder(spark, "arriving")
    # Row groups small enough that a batch of one large file is read by many tasks.
    raw.repartition(5, "o_orderkey").write.option("parquet.block.size", 8 << 20).parquet(files)
    stream_deltas(
        spark, env, files, raw.schema, new_folder(spark, "stream"), map_orders, fold_every=2,
        maxFilesPerTrigger="1",
    ).awaitTermination()
    return env.store.marts().daily


_COPIES: dict[tuple[str, str], str] = {}


def _snapshot(spark: SparkSession, sf_dir: str) -> CoreTables:
    """Core tables copied to Parquet day folders and read back; copied once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _COPIES:
        _COPIES[key] = _copy(spark, sf_dir)
    return core_source.read_core(spark, _COPIES[key])


def _copy(spark: SparkSession, sf_dir: str) -> str:
    core = sample_core(spark, sf_dir)
    extra = {
        "promo_codes": core.orders.select(F.col("promo_code").alias("code")).distinct(),
        "bonus_grants": core.referral_earnings.select("order_id", "stars"),
    }

    def fetch(name: str) -> DataFrame:
        if name in extra:
            return extra[name]
        if name in core_source.SCHEMAS:
            return getattr(core, name)
        return spark.read.parquet(f"{sf_dir}/{name}")

    target = new_folder(spark, "snapshot")
    core_source.snapshot_core(fetch, target)
    return target


@query("snapshot_orders")
def snapshot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).orders.drop("timestamp_day")


@query("snapshot_mart_daily")
def snapshot_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.build_daily(_snapshot(spark, sf_dir), FULL, CFG)


@query("snapshot_payments_daily")
def snapshot_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments.payments_daily(_snapshot(spark, sf_dir), FULL, CFG)


# --- panel ---------------------------------------------------------------------------------


def _wide_money(df: DataFrame) -> DataFrame:
    """Summed money in the oracle's type."""
    money = [c for c in df.columns if c.endswith("_rub")]
    return df.withColumns({c: F.col(c).cast("decimal(24,2)") for c in money})


on_marts("p_provider_totals", lambda core, m: _wide_money(panel.provider_totals(m, FULL)))
on_marts("p_product_totals", lambda core, m: _wide_money(panel.product_totals(m, FULL)))
on_marts("p_promo_totals", lambda core, m: _wide_money(panel.promo_totals(m, FULL)))
on_marts("p_period_compare", lambda core, m: panel.period_compare(m, RECENT))
on_marts(
    "p_period_compare_buyers",
    lambda core, m: panel.period_compare(m, RECENT, "unique_buyers_count"),
)
on_marts("p_cohort_matrix", lambda core, m: panel.cohort_matrix(m.cohort_weekly))
on_marts("p_cohort_cells", lambda core, m: panel.cohort_cells(
    m.cohort_weekly.where("age_week = 0 OR age_week % 2 = 1"), ages=6))
on_core(
    "p_hourly_matrix",
    lambda core: panel.hourly_matrix(insights.hourly_heatmap(core, FULL, CFG)),
)
on_core(
    "p_provider_success",
    lambda core: panel.provider_success(payments.payments_providers(core, FULL, CFG)),
)
on_marts("p_provider_bars", lambda core, m: panel.provider_bars(m, FULL))
on_marts(
    "p_recent_referrals",
    lambda core, m: panel.recent_referrals(payments.referrals(core, m, FULL, CFG)),
)
on_marts("p_first_cohorts", lambda core, m: panel.first_cohorts(m.cohort_weekly))
