"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Lazy queries, timed over the supplied tables; and one job, timed as a whole.
HEADLINE = [
    "mart_daily",
    "mart_provider_daily",
    "mart_product_daily",
    "mart_referral_daily",
    "mart_promo_daily",
    "mart_cohort_weekly",
    "q_summary",
    "q_day_breakdown",
    "q_day_buyers",
    "q_day_orders",
    "q_funnel",
    "q_payments_daily",
    "q_payments_providers",
    "q_payment_failures",
    "q_referrals",
    "q_kpis",
    "q_anomalies",
    "q_hourly_heatmap",
    "q_users",
    "dq_run",
]


def main() -> None:
    from checks import catalog
    from martwright.plans import jobs
    from martwright.session import build_session

    spark = build_session(
        "martwright-bench",
        spark__master=f"local[{CPUS}]",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions=CPUS,
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        start = time.perf_counter()
        action()
        return round(time.perf_counter() - start, 3)

    def drain(name: str) -> None:
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    drain("mart_daily")  # start-up cost belongs to no query
    seconds = {name: min(timed(lambda: drain(name)) for _ in range(2)) for name in HEADLINE}

    def full_backfill() -> None:
        jobs.backfill_full(catalog.new_environment(spark, SF_DIR), catalog.FULL)

    def thirty_days() -> None:
        jobs.backfill_daily(catalog.new_environment(spark, SF_DIR), catalog.RECENT)

    seconds["job_backfill_full"] = timed(full_backfill)
    seconds["job_backfill_30_days"] = timed(thirty_days)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds, headline queries and jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(SF_DIR).name.removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
