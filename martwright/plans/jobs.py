"""Refresh jobs: build, upsert, and keep a run ledger."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from martwright.operators.workdir import materialize
from martwright.plans import marts as m
from martwright.plans import purchases
from martwright.plans.quality import find_issues
from martwright.ranges import DAY, DateRange, cohort_window, refresh_window
from martwright.settings import Settings
from martwright.sources.core import CoreTables
from martwright.sources.store import LEASE, MartStore

# Names under which runs are logged. Fixed values.
DAILY_JOB = "DailyMetricsBackfillJob"
REFERRAL_JOB = "ReferralMetricsBackfillJob"
COHORT_JOB = "CohortMetricsBackfillJob"
QUALITY_JOB = "DataQualityCheckJob"
# A name of this library's own.
BUYERS_JOB = "BuyerMonthsJob"

QUALITY_DAYS = 31


@dataclass(frozen=True)
class Environment:
    core: CoreTables
    store: MartStore
    cfg: Settings

    def reopened(self) -> Environment:
        """The same with the source opened anew: it then shows the files that are there now."""
        return replace(self, core=self.core.reopened())


def run_logged(env: Environment, job: str, rng: DateRange, work: Callable[[], int]) -> int:
    """Run ``work`` between a 'running' and a 'success' or 'failed' entry; failures re-raise.

    While it runs a thread renews the run's lease, so that a run whose driver is gone is known as
    failed when the lease has passed.
    """
    run = env.store.open_run(job, rng, env.cfg.now())
    done = threading.Event()

    def renew() -> None:
        while not done.wait(LEASE.total_seconds() / 3):
            env.store.renew_run(run, env.cfg.now())

    threading.Thread(target=renew, daemon=True).start()
    try:
        rows = work()
    except Exception as error:
        done.set()
        env.store.close_run(run, "failed", env.cfg.now(), error=str(error))
        raise
    done.set()
    env.store.close_run(run, "success", env.cfg.now(), rows=rows)
    return rows


def refresh_sales(env: Environment, rng: DateRange, everything: bool = True) -> None:
    """Daily, provider and product marts, and with ``everything`` referral and promo too.

    Two small grains are computed once and feed the builders: sales by (day, provider, product)
    and paid orders by (day, user). A ``DaySet`` reads and writes its days only.
    """
    core, cfg = env.core, env.cfg
    buyers = m.buyer_days(core, rng, cfg)
    buyers = materialize(buyers) if everything else buyers
    write_sales(env, rng, m.sales_mix(core, rng, cfg), buyers)
    if everything:
        at = cfg.now()
        env.store.upsert("referral_daily", m.build_referral_daily(core, rng, cfg, buyers), rng, at)
        env.store.upsert("promo_daily", m.build_promo_daily(core, rng, cfg), rng, at)


def write_sales(env: Environment, rng: DateRange, mix: DataFrame, buyers: DataFrame) -> None:
    """Daily, provider and product marts from the two grains; ``mix`` is read three times and
    computed once."""
    core, cfg, at = env.core, env.cfg, env.cfg.now()
    mix = materialize(mix)
    env.store.upsert("daily", m.build_daily(core, rng, cfg, mix, buyers), rng, at)
    env.store.upsert("provider_daily", m.build_provider_daily(core, rng, cfg, mix), rng, at)
    env.store.upsert("product_daily", m.build_product_daily(core, rng, cfg, mix), rng, at)


def backfill_daily(env: Environment, rng: DateRange) -> int:
    """All five day-keyed marts; returns the number of days."""
    env = env.reopened()

    def work() -> int:
        refresh_sales(env, rng)
        return rng.days

    return run_logged(env, DAILY_JOB, rng, work)


def backfill_referral(env: Environment, rng: DateRange) -> int:
    """Referral and promo marts only; returns the number of days."""
    env = env.reopened()

    def work() -> int:
        at = env.cfg.now()
        for name in ("referral_daily", "promo_daily"):
            env.store.upsert(name, m.BUILDERS[name](env.core, rng, env.cfg), rng, at)
        return rng.days

    return run_logged(env, REFERRAL_JOB, rng, work)


def refresh_buyers(env: Environment, rng: DateRange) -> None:
    """Rebuild the kept purchases of the months that the range touches, from their orders alone."""
    rows = purchases.build_buyer_months(env.core, rng, env.cfg)
    env.store.replace_buyer_months(rows, rng)


def backfill_buyers(env: Environment, rng: DateRange) -> int:
    """Build the purchases of all history, stated as a range, once. From then on the cohort job
    reads them and keeps them up to date; returns the number of months."""
    env = env.reopened()

    def work() -> int:
        refresh_buyers(env, rng)
        return len(rng.months())

    return run_logged(env, BUYERS_JOB, rng, work)


def first_purchases(env: Environment, rng: DateRange) -> DataFrame | None:
    """First purchases with the months of the range's cohorts and of their ages made anew; None
    where they are not kept."""
    if env.store.buyer_months() is None:
        return None
    weeks = rng.weeks()
    last = min(max(env.cfg.today(), weeks.end + 6 * DAY), weeks.end + DAY * (7 * m.COHORT_AGES - 1))
    refresh_buyers(env, DateRange(weeks.start, last))
    return purchases.purchases(env.store.buyer_months())


def backfill_cohort(env: Environment, rng: DateRange) -> int:
    """Cohorts whose first week lies in the range; returns the number of weeks."""
    env = env.reopened()

    def work() -> int:
        built = m.build_cohort_weekly(env.core, rng, env.cfg, first_purchases(env, rng))
        env.store.upsert("cohort_weekly", built, rng.weeks(), env.cfg.now())
        return rng.week_count

    return run_logged(env, COHORT_JOB, rng, work)


def check_quality(env: Environment, rng: DateRange | None = None) -> int:
    """Append what the checks find; returns the number of issues. Default: the last 31 days."""
    rng = rng or DateRange.last(QUALITY_DAYS, env.cfg.today())
    env = env.reopened()

    def work() -> int:
        daily = env.store.read("daily")
        issues = materialize(find_issues(env.core, daily, rng, env.cfg, env.cfg.now()))
        env.store.append_issues(issues)
        return issues.count()

    return run_logged(env, QUALITY_JOB, rng, work)


def backfill_full(env: Environment, rng: DateRange) -> int:
    """Day marts, cohorts, then the checks; returns the number of issues found."""
    backfill_daily(env, rng)
    backfill_cohort(env, rng)
    return check_quality(env, rng)


def incremental_refresh(
    env: Environment, mode: str = "today", as_of: dt.date | None = None
) -> None:
    """Recompute a rolling window; the longest one refreshes the recent cohorts as well."""
    day = as_of or env.cfg.today()
    backfill_daily(env, refresh_window(mode, day))
    if mode == "last_30_days":
        backfill_cohort(env, cohort_window(day))
