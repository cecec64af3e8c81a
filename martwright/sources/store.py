"""Stored marts and logs: range reads, keyed upserts, appends, and CSV / JSON exports.

A mart lies in Parquet folders per calendar month, so a daily mart of many years stays a few
files, a range read opens only its months, and an upsert rewrites only the months it touches.
Months are replaced under a manifest (``operators.versions``): a reader sees the mart before an
upsert or after it, and writers that meet on a month take turns.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions.calendar import instant
from martwright.operators.files import join_parts, parts_of, remove_folder, write_lines
from martwright.operators.frames import matching, top
from martwright.operators.keyed_merge import merge_rows
from martwright.operators.versions import Conflict, Version, VersionedFolder
from martwright.operators.workdir import new_folder
from martwright.plans.marts import MARTS, Marts
from martwright.plans.purchases import BUYER_MONTHS, BUYER_MONTHS_DDL
from martwright.plans.quality import ISSUES_SCHEMA
from martwright.ranges import DateRange

AUDIT = "created_at timestamp_ntz, updated_at timestamp_ntz"
MONTH = "month"
RUNS_SCHEMA = """
    run_id string, step int, job_name string, range_start date, range_end date, status string,
    rows_written int, error_text string, started_at timestamp_ntz, finished_at timestamp_ntz,
    created_at timestamp_ntz, lease_until timestamp_ntz"""
LAST_STEP = 2**31 - 1

#: How long a run counts as running after its last sign of life.
LEASE = dt.timedelta(minutes=10)
EXPIRED = "lease expired"

#: How often an upsert starts again after other writers' upserts of the same months.
UPSERT_ATTEMPTS = 5

# Kept of a failed run's error text; None keeps all of it. Fixed value.
ERROR_TEXT_LENGTH: int | None = 2000

# Export kinds and the mart each one lists; any other kind lists the daily mart. Fixed values.
EXPORT_KINDS = {
    "daily": "daily",
    "providers": "provider_daily",
    "products": "product_daily",
    "referrals": "referral_daily",
    "promos": "promo_daily",
    "cohorts": "cohort_weekly",
}


def _literal(value, kind: T.DataType) -> Column:
    return instant(value) if isinstance(value, dt.datetime) else F.lit(value).cast(kind)


@dataclass(frozen=True)
class MartStore:
    spark: SparkSession
    root: str

    # --- reading -----------------------------------------------------------------------

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _load(self, name: str, schema: T.StructType) -> DataFrame:
        """Stored rows, or none where nothing has been written yet."""
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _folder(self, name: str) -> VersionedFolder:
        return VersionedFolder(self.spark, self._path(name), MONTH)

    def version(self, name: str) -> Version:
        """The mart as it is now; what is read of it later stays the same."""
        return self._folder(name).current()

    def _months(self, name: str, rng: DateRange | None, version: Version) -> DataFrame:
        schema = T.StructType.fromDDL(f"{MARTS[name].ddl}, {AUDIT}, {MONTH} date")
        months = None if rng is None else [str(m) for m in rng.months()]
        return self._folder(name).read(version, schema, months)

    def read(
        self, name: str, rng: DateRange | None = None, version: Version | None = None
    ) -> DataFrame:
        """Key, measures and audit columns; only the months of ``rng`` are opened."""
        rows = self._months(name, rng, version or self.version(name))
        if rng is not None:
            rows = rows.where(rng.holds(F.col(MARTS[name].period)))
        return rows.drop(MONTH)

    def marts(self, rng: DateRange | None = None) -> Marts:
        """All marts without audit columns, as the metric queries take them; each as it was when
        this was called."""
        versions = {name: self.version(name) for name in MARTS}

        def fetch(name: str) -> DataFrame:
            weekly = rng is not None and name == "cohort_weekly"
            rows = self.read(name, rng.weeks() if weekly else rng, versions[name])
            return rows.drop("created_at", "updated_at")

        return Marts(fetch)

    # --- writing -----------------------------------------------------------------------

    def upsert(self, name: str, updates: DataFrame, rng: DateRange, at: dt.datetime) -> None:
        """Insert new keys, update known ones, keep the rest; ``rng`` spans the update's dates.

        Rows already stored in the touched months are carried over, and new folders of these
        months take the place of the old ones in one step. Running it again gives the same table.
        An update outside ``rng`` stops the write, as it would replace a month whose rows were not
        carried over. Another writer's upsert of the same month makes this one start again on top
        of it.
        """
        spec, folder = MARTS[name], self._folder(name)
        period = F.col(spec.period)
        refusal = F.raise_error(F.lit(f"{name} update outside {rng.start}..{rng.end}"))
        checked = updates.withColumn(
            spec.period, F.when(rng.holds(period), period).otherwise(refusal.cast("date"))
        )
        for attempt in range(UPSERT_ATTEMPTS):
            base = folder.current()
            merged = merge_rows(
                self._months(name, rng, base).drop(MONTH), checked, spec.keys, instant(at)
            )
            parts = folder.write(
                merged.withColumn(MONTH, F.trunc(period, "month")).hint("rebalance", MONTH)
            )
            try:
                folder.publish(base, [str(m) for m in rng.months()], parts)
                return
            except Conflict:
                if attempt + 1 == UPSERT_ATTEMPTS:
                    raise

    def buyer_months(self) -> DataFrame | None:
        """The kept purchases by (user, month); None before they have been built."""
        folder = self._folder(BUYER_MONTHS)
        version = folder.current()
        schema = T.StructType.fromDDL(BUYER_MONTHS_DDL)
        return folder.read(version, schema) if version.number else None

    def replace_buyer_months(self, rows: DataFrame, rng: DateRange) -> None:
        """Put these rows in place of the range's months, in one step."""
        folder = self._folder(BUYER_MONTHS)
        base = folder.current()
        parts = folder.write(rows.hint("rebalance", MONTH))
        folder.publish(base, [str(m) for m in rng.months()], parts)

    def vacuum(self, before: dt.datetime) -> int:
        """Remove what writes before this UTC time left behind; returns the folders removed."""
        return sum(self._folder(name).vacuum(before) for name in [*MARTS, BUYER_MONTHS])

    def append_issues(self, issues: DataFrame) -> None:
        issues.write.mode("append").parquet(self._path("data_quality_issues"))

    def issues(self) -> DataFrame:
        return self._load("data_quality_issues", T.StructType.fromDDL(ISSUES_SCHEMA))

    # --- job ledger --------------------------------------------------------------------

    def _log(self, **values) -> None:
        row = self.spark.range(0, 1, 1, 1).select(
            *[
                _literal(values.get(f.name), f.dataType).alias(f.name)
                for f in T.StructType.fromDDL(RUNS_SCHEMA)
            ]
        )
        row.write.mode("append").parquet(self._path("job_runs"))

    def open_run(self, job_name: str, rng: DateRange, at: dt.datetime) -> dict:
        run = {
            "run_id": uuid.uuid4().hex,
            "job_name": job_name,
            "range_start": rng.start,
            "range_end": rng.end,
            "started_at": at,
            "created_at": at,
        }
        self._log(**run, step=0, status="running", lease_until=at + LEASE)
        return run

    def renew_run(self, run: dict, at: dt.datetime) -> None:
        """A sign of life: the run counts as running for another lease."""
        step = int((at - run["started_at"]).total_seconds()) + 1
        self._log(**run, step=step, status="running", lease_until=at + LEASE)

    def close_run(
        self, run: dict, status: str, at: dt.datetime, rows: int | None = None, error: str = ""
    ) -> None:
        self._log(
            **run,
            step=LAST_STEP,
            status=status,
            rows_written=rows,
            error_text=error[:ERROR_TEXT_LENGTH] or None,
            finished_at=at,
        )

    def _run_log(self) -> DataFrame:
        return self._load("job_runs", T.StructType.fromDDL(RUNS_SCHEMA))

    def runs(self, at: dt.datetime | None = None) -> DataFrame:
        """Latest state of every run. The log only grows; a run's last entry is its state.

        As of ``at``, a run that still counts as running after its lease is a failed one.
        """
        log = self._run_log()
        rest = [c for c in log.columns if c not in ("run_id", "step")]
        latest = log.groupBy("run_id").agg(F.max_by(F.struct(*rest), "step").alias("run"))
        found = latest.select("run_id", *[F.col(f"run.{c}").alias(c) for c in rest])
        if at is not None:
            lost = (F.col("status") == "running") & (F.col("lease_until") < instant(at))
            found = found.withColumns({
                "status": F.when(lost, "failed").otherwise(F.col("status")),
                "error_text": F.when(lost, EXPIRED).otherwise(F.col("error_text")),
                "finished_at": F.when(lost, F.col("lease_until")).otherwise(F.col("finished_at")),
            })
        return found.drop("lease_until")

    def compact_runs(self) -> None:
        """Put one file in place of the log's many: the last entry of each run.

        The new file is written before the old ones go; an entry that is read twice meanwhile is
        the same entry. Entries that others append stay, as only the files read are removed.
        """
        log = self._run_log()
        files = log.inputFiles()
        if len(files) < 2:
            return
        rest = [c for c in log.columns if c != "run_id"]
        last = log.groupBy("run_id").agg(F.max_by(F.struct(*rest), "step").alias("r"))
        kept = last.select("run_id", *[F.col(f"r.{c}").alias(c) for c in rest])
        kept.select(*log.columns).coalesce(1).write.mode("append").parquet(self._path("job_runs"))
        for name in files:
            remove_folder(self.spark, name)

    # --- exports -----------------------------------------------------------------------

    def export_rows(self, kind: str, rng: DateRange) -> DataFrame:
        name = EXPORT_KINDS.get(kind, "daily")
        span = rng.weeks() if name == "cohort_weekly" else rng
        return self.read(name, span).orderBy(*MARTS[name].keys)

    def export_csv(self, kind: str, rng: DateRange, folder: str, one_file: bool = True) -> str:
        """Ordered CSV under one header, as one file; an empty range leaves an empty file.

        The rows are sorted and written by many tasks, and their parts joined in order. Without
        ``one_file`` they stay a folder of parts, each with the header, for readers of such.
        """
        path = f"{folder}/metrics_{kind or 'daily'}_{rng.start}_{rng.end}.csv"
        rows = self.export_rows(kind, rng)
        if not one_file:
            rows.write.mode("overwrite").option("header", True).csv(path)
            return path
        parts = new_folder(self.spark, "csv")
        rows.write.csv(parts)
        listed = parts_of(self.spark, parts)
        header = (",".join(rows.columns) + "\n").encode() if listed else b""
        join_parts(self.spark, path, [header, *listed])
        remove_folder(self.spark, parts)
        return path


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, NULL fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(bundle: dict[str, DataFrame], folder: str) -> None:
    """A query bundle as JSON lines, one sub-folder per part."""
    for part, df in bundle.items():
        json_rows(df).write.mode("overwrite").text(f"{folder}/{part}")


def write_document(path: str, fields: dict[str, object], objects: tuple[str, ...] = ()) -> None:
    """One JSON document in one file, fields in the order given.

    A frame becomes the list of its rows in their order; a one-row frame named in ``objects``
    becomes an object (null if it has no row). Dates become ISO texts, other values what they are
    in JSON. Lists of any length are written by tasks and joined as a stream.
    """
    spark = next(v for v in fields.values() if isinstance(v, DataFrame)).sparkSession
    pieces: list = []
    folders = []
    for i, (name, value) in enumerate(fields.items()):
        pieces.append(("{" if i == 0 else ",").encode() + f"\n{json.dumps(name)}: ".encode())
        if not isinstance(value, DataFrame):
            plain = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value
            pieces.append(json.dumps(plain).encode())
            continue
        lines = json_rows(value).select(F.concat(F.lit(","), "value").alias("value"))
        folders.append(write_lines(lines))
        parts = parts_of(spark, folders[-1])
        first = [(p, 1) for p in parts[:1]]  # without the comma before the first row
        if name in objects:
            pieces += first or [b"null"]
        else:
            pieces += [b"[", *first, *parts[1:], b"]"]
    join_parts(spark, path, [*pieces, b"\n}\n"])
    for folder in folders:
        remove_folder(spark, folder)


# --- log queries -----------------------------------------------------------------------------


def list_runs(runs: DataFrame, job_name=None, status=None, limit: int | None = None) -> DataFrame:
    """Newest first; all of them, or the first ``limit``."""
    kept = matching(runs, job_name=job_name, status=status)
    return top(kept, limit, F.desc("created_at"), F.asc("job_name"), F.asc("run_id"))


def runs_summary(runs: DataFrame, at: dt.datetime) -> DataFrame:
    """Runs in progress now, and outcomes of the last 24 hours before ``at``."""
    status = F.col("status")
    recent = F.col("created_at") >= instant(at - dt.timedelta(hours=24))
    return runs.agg(
        F.count_if(status == "running").alias("running"),
        F.count_if((status == "failed") & recent).alias("failed_last_24h"),
        F.count_if((status == "success") & recent).alias("success_last_24h"),
    )


def last_success(runs: DataFrame, job_name: str) -> DataFrame:
    done = runs.where((F.col("job_name") == job_name) & (F.col("status") == "success"))
    return top(done, 1, F.desc("finished_at")).select(
        F.col("finished_at").alias("last_successful_aggregation_at")
    )
