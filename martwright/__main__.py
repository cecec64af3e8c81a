"""Refresh jobs and exports from the command line."""

from __future__ import annotations

import argparse
import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from martwright.plans import jobs
from martwright.ranges import REFRESH_DAYS, DateRange
from martwright.session import build_session
from martwright.settings import Settings
from martwright.sources.core import read_core
from martwright.sources.store import EXPORT_KINDS, MartStore

BACKFILLS = {
    "backfill_daily": jobs.backfill_daily,
    "backfill_referral": jobs.backfill_referral,
    "backfill_cohort": jobs.backfill_cohort,
    "backfill_full": jobs.backfill_full,
    "check_quality": jobs.check_quality,
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="martwright", description=__doc__)
    parser.add_argument("--core", required=True, help="folder of the core tables")
    parser.add_argument("--marts", required=True, help="folder of the marts and logs")
    parser.add_argument("--settings", help="JSON file of settings: zone, statuses, ...")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in BACKFILLS:
        sub = commands.add_parser(name)
        sub.add_argument("start", type=dt.date.fromisoformat)
        sub.add_argument("end", type=dt.date.fromisoformat)
    refresh = commands.add_parser("refresh")
    refresh.add_argument("mode", choices=list(REFRESH_DAYS))
    refresh.add_argument("--as-of", type=dt.date.fromisoformat)
    export = commands.add_parser("export")
    export.add_argument("kind", choices=list(EXPORT_KINDS))
    export.add_argument("start", type=dt.date.fromisoformat)
    export.add_argument("end", type=dt.date.fromisoformat)
    export.add_argument("folder")
    return parser


def run(spark: SparkSession, argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    settings = {}
    if args.settings:
        with open(args.settings, encoding="utf-8") as file:
            settings = json.load(file)
    env = jobs.Environment(
        read_core(spark, args.core), MartStore(spark, args.marts), Settings(**settings)
    )
    if args.command == "refresh":
        jobs.incremental_refresh(env, args.mode, args.as_of)
        return
    rng = DateRange(args.start, args.end)
    if args.command == "export":
        print(env.store.export_csv(args.kind, rng, args.folder))
    else:
        print(BACKFILLS[args.command](env, rng))


def main() -> None:
    run(build_session())


if __name__ == "__main__":
    main()
