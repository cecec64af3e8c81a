"""Upserts, logs, exports, snapshots and jobs."""

import datetime as dt
from dataclasses import replace
from decimal import Decimal as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from martwright.operators.versions import Conflict, Version, VersionedFolder
from martwright.plans import jobs, marts, metrics, purchases, quality
from martwright.ranges import DateRange, DaySet
from martwright.settings import Settings
from martwright.sources import core as cs
from martwright.sources import store as st
from martwright.sources.store import MartStore
from tests.conftest import order, rows, utc

T1, T2 = utc("2024-03-01 06:00:00"), utc("2024-03-01 07:00:00")
CFG = Settings(clock=lambda: T1)
SPAN = DateRange(dt.date(2024, 1, 1), dt.date(2024, 2, 29))


@pytest.fixture
def store(spark, tmp_path):
    return MartStore(spark, str(tmp_path / "store"))


@pytest.fixture
def core(tables):
    return tables(
        users=[{"user_id": "u1", "referrer_id": "u9", "created_at": utc("2024-01-02")}],
        orders=[
            order(str(i), f"u{i % 5}", f"2024-0{1 + i % 2}-{1 + i % 28:02d} 12:00",
                  status=("paid", "created", "paid", "failed")[i % 4], amount_rub=i,
                  payment_provider=("card", "wallet", "")[i % 3], product_type="gift",
                  promo_code=("A", None)[i % 2], cost_per_star=2)
            for i in range(200)
        ],
        promo_redemptions=[{"code": "A", "created_at": utc("2024-01-09")}],
        referral_earnings=[{"order_id": "7", "stars": 3, "created_at": utc("2024-01-09")}],
        payment_transactions=[
            {"id": "1", "order_id": "7", "status": "paid", "created_at": None},
            {"id": "2", "order_id": "8", "status": "paid", "created_at": utc("2024-01-31 22:00")},
        ],
    )


def table(df):
    return sorted(map(str, rows(df)))


@pytest.mark.parametrize("name", sorted(marts.MARTS))
def test_upsert_twice_is_upsert_once(core, store, name):
    built = marts.BUILDERS[name](core, SPAN, CFG)
    span = SPAN.weeks() if name == "cohort_weekly" else SPAN
    store.upsert(name, built, span, T1)
    first = table(store.read(name))
    store.upsert(name, built, span, T1)
    assert table(store.read(name)) == first
    assert table(store.read(name).drop("created_at", "updated_at")) == table(built)
    keys = marts.MARTS[name].keys
    assert store.read(name).groupBy(*keys).count().where("count > 1").count() == 0


def test_upsert_keeps_what_the_update_lacks(spark, store):
    schema = marts.MARTS["provider_daily"].schema
    def line(day, provider, n):
        return (dt.date(2024, 1, day), provider, n, n, D(n), D(0), D(0), D(1), D(1))

    old = [line(1, "card", 1), line(1, "wallet", 1), line(31, "card", 1)]
    new = [line(1, "card", 5), line(2, "card", 2)]
    store.upsert("provider_daily", spark.createDataFrame(old, schema), SPAN, T1)
    feb = [(dt.date(2024, 2, 1), *line(1, "card", 9)[1:])]
    store.upsert("provider_daily", spark.createDataFrame(feb, schema), SPAN, T1)
    january = DateRange(dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    store.upsert("provider_daily", spark.createDataFrame(new, schema), january, T2)
    got = {
        (r["date"].month, r["date"].day, r["payment_provider"]): (
            r["orders_created_count"], r["created_at"], r["updated_at"],
        )
        for r in rows(store.read("provider_daily"))
    }
    assert got == {
        (1, 1, "card"): (5, T1, T2),
        (1, 1, "wallet"): (1, T1, T1),
        (1, 2, "card"): (2, T2, T2),
        (1, 31, "card"): (1, T1, T1),
        (2, 1, "card"): (9, T1, T1),
    }


def test_upsert_leaves_other_months_alone(core, store):
    store.upsert("daily", marts.build_daily(core, SPAN, CFG), SPAN, T1)
    january = store.version("daily").parts["2024-01-01"]
    feb = DateRange(dt.date(2024, 2, 3), dt.date(2024, 2, 4))
    store.upsert("daily", marts.build_daily(core, feb, CFG), feb, T2)
    assert store.version("daily").parts["2024-01-01"] == january
    moved = store.read("daily").where(F.col("updated_at") == F.lit(str(T2)).cast("timestamp_ntz"))
    assert [r["date"].day for r in rows(moved.orderBy("date"))] == [3, 4]
    assert store.read("daily").count() == 60


def test_update_outside_its_range_is_refused(core, store):
    built = marts.build_daily(core, SPAN, CFG)
    store.upsert("daily", built, SPAN, T1)
    before = table(store.read("daily"))
    with pytest.raises(Exception, match="daily update outside"):
        store.upsert("daily", built, DateRange(dt.date(2024, 2, 1), SPAN.end), T2)
    assert table(store.read("daily")) == before


def test_range_read_opens_its_months_only(core, store):
    store.upsert("daily", marts.build_daily(core, SPAN, CFG), SPAN, T1)
    part = store.read("daily", DateRange(dt.date(2024, 2, 1), dt.date(2024, 2, 9)))
    assert part.count() == 9
    files = part.inputFiles()  # not even listed: the other month
    assert files and all("/month=2024-02-01/" in name for name in files)


def test_reading_before_any_write_is_empty(store):
    assert store.read("daily").count() == 0
    assert store.issues().count() == 0
    assert rows(st.runs_summary(store.runs(), T1))[0] == {
        "running": 0, "failed_last_24h": 0, "success_last_24h": 0,
    }
    assert rows(metrics.summary(store.marts(SPAN), SPAN))[0]["top_provider"] is None


# --- versions ------------------------------------------------------------------------------


FEB = DateRange(dt.date(2024, 2, 1), SPAN.end)
JAN = DateRange(SPAN.start, dt.date(2024, 1, 31))


def test_a_reader_keeps_its_version(core, store):
    """A frame and a bundle of marts opened before an upsert, and read after it."""
    store.upsert("daily", marts.build_daily(core, SPAN, CFG), SPAN, T1)
    before = table(store.read("daily"))
    opened, bundle = store.read("daily"), store.marts(SPAN)
    emptied = marts.build_daily(core, SPAN, CFG).withColumn("orders_paid_count", F.lit(-1).cast("bigint"))
    store.upsert("daily", emptied, SPAN, T2)
    assert table(opened) == before
    assert bundle.daily.where("orders_paid_count = -1").count() == 0
    assert store.read("daily").where("orders_paid_count = -1").count() == 60


def test_a_write_that_stops_half_way_changes_nothing(core, store, monkeypatch):
    store.upsert("daily", marts.build_daily(core, SPAN, CFG), SPAN, T1)
    before, version = table(store.read("daily")), store.version("daily")
    broken = marts.build_daily(core, SPAN, CFG).withColumn(
        "orders_paid_count",
        F.when(F.col("date") == F.lit(SPAN.end), F.raise_error(F.lit("lost")).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint")),
    )
    with pytest.raises(Exception, match="lost"):
        store.upsert("daily", broken, SPAN, T2)
    assert store.version("daily") == version and table(store.read("daily")) == before

    def dies(self, *a):  # all files are written, the manifest is not
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedFolder, "_put", dies)
        with pytest.raises(OSError):
            store.upsert("daily", marts.build_daily(core, FEB, CFG), FEB, T2)
    assert store.version("daily") == version and table(store.read("daily")) == before
    store.upsert("daily", marts.build_daily(core, FEB, CFG), FEB, T2)
    assert store.read("daily").count() == 60


def test_two_writers_of_one_month_both_arrive(spark, core, store, monkeypatch):
    """A second writer publishes while the first is still writing: neither update is lost."""
    store.upsert("provider_daily", marts.build_provider_daily(core, SPAN, CFG), SPAN, T1)
    schema = marts.MARTS["provider_daily"].schema

    def line(provider, n):
        return spark.createDataFrame(
            [(FEB.start, provider, n, n, D(n), D(0), D(0), D(1), D(1))], schema)

    plain, met = VersionedFolder.write, []

    def write(self, df):
        parts = plain(self, df)
        if not met:
            met.append(1)
            MartStore(spark, store.root).upsert("provider_daily", line("new two", 2), FEB, T2)
        return parts

    monkeypatch.setattr(VersionedFolder, "write", write)
    store.upsert("provider_daily", line("new one", 1), FEB, T2)
    got = {r.payment_provider: r.orders_created_count
           for r in store.read("provider_daily", FEB).where("payment_provider LIKE 'new%'").collect()}
    assert got == {"new one": 1, "new two": 2}
    keys = ["date", "payment_provider"]
    assert store.read("provider_daily").groupBy(*keys).count().where("count > 1").isEmpty()


def test_writers_of_different_months_do_not_wait(core, store, monkeypatch):
    writes = []
    plain = VersionedFolder.write

    def write(self, df):
        parts = plain(self, df)
        writes.append(parts)
        if len(writes) == 1:
            store.upsert("daily", marts.build_daily(core, JAN, CFG), JAN, T1)
        return parts

    monkeypatch.setattr(VersionedFolder, "write", write)
    store.upsert("daily", marts.build_daily(core, FEB, CFG), FEB, T1)
    assert len(writes) == 2 and store.read("daily").count() == 60
    assert store.version("daily").number == 2


def test_conflict_without_end_is_told(core, store, monkeypatch):
    store.upsert("daily", marts.build_daily(core, FEB, CFG), FEB, T1)
    monkeypatch.setattr(VersionedFolder, "current", lambda self: Version(0, {}))
    monkeypatch.setattr(VersionedFolder, "publish", lambda *a: (_ for _ in ()).throw(Conflict("x")))
    with pytest.raises(Conflict):
        store.upsert("daily", marts.build_daily(core, FEB, CFG), FEB, T2)


def test_numbers_are_given_once(spark, tmp_path):
    folder = VersionedFolder(spark, str(tmp_path / "t"), "month")
    assert folder.current() == Version()
    assert folder._put(Version(1, {"a": "x"})) and not folder._put(Version(1, {"a": "y"}))
    assert folder.current() == Version(1, {"a": "x"})
    after = folder.publish(Version(0, {"a": "x"}), ["b"], {"b": "z"})
    assert after == Version(2, {"a": "x", "b": "z"})
    with pytest.raises(Conflict):
        folder.publish(Version(1, {"a": "old"}), ["a"], {"a": "new"})
    assert folder.publish(after, ["a"], {}) == Version(3, {"b": "z"})


def test_vacuum_removes_what_is_out_of_use(core, store):
    for at in (T1, T2, T2):
        store.upsert("daily", marts.build_daily(core, SPAN, CFG), SPAN, at)
    store.upsert("daily", marts.build_daily(core, FEB, CFG), FEB, T2)
    want = table(store.read("daily"))
    root = Path(store.root) / "daily"
    assert store.vacuum(utc("2000-01-01")) == 0
    assert len(list(root.glob("version=*/month=*"))) == 7
    assert store.vacuum(utc("2100-01-01")) == 5  # what is left: January of the third, February
    assert table(store.read("daily")) == want
    assert len(list(root.glob("version=*/month=*"))) == 2
    assert len(list((root / "_manifest").glob("*.json"))) == 1


# --- jobs ----------------------------------------------------------------------------------


@pytest.fixture
def env(core, store):
    return jobs.Environment(core, store, CFG)


def test_full_backfill(env):
    assert jobs.backfill_full(env, SPAN) == 0
    for name, build in marts.BUILDERS.items():
        stored = env.store.read(name).drop("created_at", "updated_at")
        assert table(stored) == table(build(env.core, SPAN, CFG)), name
    runs = {r["job_name"]: r for r in rows(st.list_runs(env.store.runs()))}
    assert {k: (r["status"], r["rows_written"]) for k, r in runs.items()} == {
        jobs.DAILY_JOB: ("success", 60),
        jobs.COHORT_JOB: ("success", 9),
        jobs.QUALITY_JOB: ("success", 0),
    }
    assert rows(st.last_success(env.store.runs(), jobs.DAILY_JOB)) == [
        {"last_successful_aggregation_at": T1}
    ]


def test_daily_totals_agree_across_marts(env):
    jobs.backfill_daily(env, SPAN)
    def sums(name):
        return {r["date"]: r["s"] for r in rows(
            env.store.read(name).groupBy("date").agg(F.sum("revenue_rub").alias("s"))) if r["s"]}

    assert sums("daily") == sums("provider_daily") == sums("product_daily")


def test_failed_run_is_logged_and_raised(env):
    def work():
        raise RuntimeError("x" * 3000)

    with pytest.raises(RuntimeError):
        jobs.run_logged(env, jobs.DAILY_JOB, SPAN, work)
    run = rows(st.list_runs(env.store.runs(), status="failed"))[0]
    assert run["error_text"] == "x" * 2000 and run["finished_at"] == T1
    assert rows(st.list_runs(env.store.runs(), status="running")) == []
    assert rows(st.last_success(env.store.runs(), jobs.DAILY_JOB)) == []
    later = T1 + dt.timedelta(hours=25)
    assert rows(st.runs_summary(env.store.runs(), T1))[0]["failed_last_24h"] == 1
    assert rows(st.runs_summary(env.store.runs(), later))[0]["failed_last_24h"] == 0


def test_open_run_counts_as_running(env):
    env.store.open_run(jobs.DAILY_JOB, SPAN, T1)
    assert rows(st.runs_summary(env.store.runs(), T1))[0]["running"] == 1
    assert len(rows(st.list_runs(env.store.runs(), job_name=jobs.DAILY_JOB))) == 1
    assert rows(st.list_runs(env.store.runs(), job_name="other")) == []


def test_kept_purchases_take_moved_and_withdrawn_orders(tables, store):
    """Random changes of orders, month by month refreshed: cohorts as from all history."""
    import random

    rng, facts = random.Random(4), {}

    def current():
        return tables(orders=[
            order(str(i), user, f"{when} 12:00", status=status, amount_rub=5)
            for i, (user, when, status) in facts.items()])

    def change(i):
        when = SPAN.start + dt.timedelta(days=rng.randrange(SPAN.days))
        touched = [facts[i][1]] if i in facts else []
        facts[i] = (f"u{rng.randrange(12)}" if rng.random() < 0.9 else None, when,
                    rng.choice(["paid", "paid", "failed"]))
        return [*touched, when]

    for i in range(60):
        change(i)
    jobs.backfill_buyers(jobs.Environment(current(), store, CFG), SPAN)
    for _ in range(3):
        days = [d for _ in range(6) for d in change(rng.randrange(80))]
        env = jobs.Environment(current(), store, CFG)
        jobs.refresh_buyers(env, DaySet.of(days))
        jobs.refresh_buyers(env, DaySet.of(days))  # again: the same
        firsts = purchases.purchases(store.buyer_months())
        late = DateRange(dt.date(2024, 2, 5), SPAN.end)
        want = table(marts.build_cohort_weekly(env.core, late, CFG))
        assert table(marts.build_cohort_weekly(env.core, late, CFG, firsts)) == want
        assert jobs.backfill_cohort(env, late) == 4
        stored = store.read("cohort_weekly", late.weeks()).drop("created_at", "updated_at")
        assert set(want) <= set(table(stored))


def test_a_lost_run_fails_when_its_lease_ends(env):
    run = env.store.open_run(jobs.DAILY_JOB, SPAN, T1)
    soon, late = T1 + dt.timedelta(minutes=5), T1 + st.LEASE + dt.timedelta(seconds=1)

    def states(at):
        return [(r["status"], r["error_text"], r["finished_at"]) for r in rows(env.store.runs(at))]

    assert states(None) == states(soon) == [("running", None, None)]
    assert states(late) == [("failed", st.EXPIRED, T1 + st.LEASE)]
    assert rows(st.runs_summary(env.store.runs(late), late))[0]["failed_last_24h"] == 1
    env.store.renew_run(run, soon)
    assert states(late) == [("running", None, None)]
    env.store.close_run(run, "success", late, rows=3)
    assert states(late + st.LEASE) == [("success", None, late)]


def test_a_running_job_renews_its_lease(env, monkeypatch):
    import time

    monkeypatch.setattr(jobs, "LEASE", dt.timedelta(seconds=0.3))
    renewed = []
    monkeypatch.setattr(MartStore, "renew_run", lambda self, run, at: renewed.append(run["run_id"]))
    assert jobs.run_logged(env, jobs.DAILY_JOB, SPAN, lambda: time.sleep(1) or 1) == 1
    count = len(renewed)
    assert count >= 2
    time.sleep(0.5)
    assert len(renewed) == count  # and stops with it


def test_compacted_log_says_the_same(env):
    for i in range(3):
        run = env.store.open_run(f"job {i}", SPAN, T1)
        env.store.renew_run(run, T2)
        if i:
            env.store.close_run(run, "success", T2, rows=i)
    before = table(env.store.runs(T2))
    folder = Path(env.store.root) / "job_runs"
    assert len(list(folder.glob("*.parquet"))) == 8
    env.store.compact_runs()
    assert len(list(folder.glob("*.parquet"))) == 1 and table(env.store.runs(T2)) == before
    env.store.compact_runs()
    env.store.close_run(run, "failed", T2, error="x")
    assert table(env.store.runs(T2)) != before and env.store.runs().count() == 3


def test_incremental_refresh(env):
    as_of = dt.date(2024, 2, 20)
    jobs.incremental_refresh(env, "last_3_days", as_of)
    assert [r["date"].day for r in rows(env.store.read("daily").orderBy("date"))] == [18, 19, 20]
    assert env.store.read("cohort_weekly").count() == 0
    jobs.incremental_refresh(env, "last_30_days", as_of)
    assert env.store.read("daily").count() == 30
    assert env.store.read("cohort_weekly").count() > 0


def test_issues_are_appended_on_every_run(env):
    wide = DateRange(dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    assert jobs.check_quality(env, wide) == 4  # three missing days, one mismatch
    assert jobs.check_quality(env, wide) == 4
    summary = rows(quality.issues_summary(env.store.issues()))[0]
    assert summary == {"open_issues": 8, "critical_open_issues": 2}
    assert len(rows(quality.list_issues(env.store.issues(), resolved=False, limit=5))) == 5
    assert rows(quality.list_issues(env.store.issues(), resolved=True)) == []


def test_default_quality_range_is_31_days(core, store):
    cfg = replace(CFG, clock=lambda: utc("2024-02-29 12:00:00"))
    late = jobs.Environment(core, store, cfg)
    jobs.check_quality(late)
    run = rows(store.runs())[0]
    assert (run["range_start"], run["range_end"]) == (dt.date(2024, 1, 30), dt.date(2024, 2, 29))


# --- exports -------------------------------------------------------------------------------


def _text(path):
    if Path(path).is_file():
        return Path(path).read_text()
    parts = sorted(Path(path).glob("part-*"))
    return "".join(p.read_text() for p in parts)


def test_csv(env, tmp_path):
    jobs.backfill_daily(env, SPAN)
    for kind, name in st.EXPORT_KINDS.items():
        if name == "cohort_weekly":
            continue
        path = env.store.export_csv(kind, SPAN, str(tmp_path), one_file=True)
        assert path.endswith(f"metrics_{kind}_2024-01-01_2024-02-29.csv")
        lines = _text(path).splitlines()
        assert lines[0].split(",")[: len(marts.MARTS[name].keys)] == list(marts.MARTS[name].keys)
        assert len(lines) == env.store.read(name).count() + 1
        dates = [line.split(",")[0] for line in lines[1:]]
        assert dates == sorted(dates)
    assert env.store.export_csv("", SPAN, str(tmp_path)).endswith(
        "metrics_daily_2024-01-01_2024-02-29.csv"
    )


def test_csv_of_nothing_is_empty(env, tmp_path):
    path = env.store.export_csv("promos", SPAN, str(tmp_path))
    assert _text(path) == ""


def test_one_file_is_joined_from_many_sorted_parts(spark, env, tmp_path, monkeypatch):
    """Several tasks write; the file has one header, all rows in order, nothing left beside it."""
    jobs.backfill_daily(env, SPAN)
    want = [tuple(r) for r in env.store.export_rows("providers", SPAN).collect()]
    spread = env.store.export_rows("providers", SPAN).repartitionByRange(5, "date", "payment_provider")
    spread = spread.sortWithinPartitions("date", "payment_provider")
    monkeypatch.setattr(MartStore, "export_rows", lambda self, kind, rng: spread)
    path = env.store.export_csv("providers", SPAN, str(tmp_path / "out"))
    lines = Path(path).read_text().splitlines()
    assert lines[0] == ",".join(spread.columns) and sum(x == lines[0] for x in lines) == 1
    assert [(x.split(",")[0], x.split(",")[1].strip('"')) for x in lines[1:]] == [
        (str(r[0]), r[1]) for r in want]
    env.store.export_csv("providers", SPAN, str(tmp_path / "out"))  # again over the old one
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == [
        "metrics_providers_2024-01-01_2024-02-29.csv"]
    folder = env.store.export_csv("providers", SPAN, str(tmp_path / "parts"), one_file=False)
    assert spark.read.option("header", True).csv(folder).count() == len(want)


def test_one_json_document(spark, tmp_path):
    import json

    many = spark.range(500).selectExpr("id", "concat('\"', id, '\\n') AS said", "null AS none")
    path = str(tmp_path / "doc" / "out.json")
    fields = {"from": SPAN.start, "limit": None, "summary": many.limit(1),
              "items": many.repartitionByRange(7, "id").sortWithinPartitions("id"),
              "nothing": many.limit(0), "no_object": many.limit(0), "n": 3}
    st.write_document(path, fields, ("summary", "no_object"))
    got = json.loads(Path(path).read_text())
    assert list(got) == list(fields)
    assert got["from"] == "2024-01-01" and got["limit"] is None and got["n"] == 3
    assert got["summary"]["id"] == 0 and got["nothing"] == [] and got["no_object"] is None
    assert [x["id"] for x in got["items"]] == list(range(500))
    assert got["items"][7] == {"id": 7, "said": '"7\n', "none": None}


def test_cohort_export_aligns_to_weeks(env):
    jobs.backfill_cohort(env, SPAN)
    wednesday = DateRange(dt.date(2024, 1, 3), dt.date(2024, 1, 3))
    weeks = {r["cohort_week"] for r in rows(env.store.export_rows("cohorts", wednesday))}
    assert weeks == {dt.date(2024, 1, 1)}


def test_json_documents(env, tmp_path):
    bundle = metrics.user_details(env.core, "u1", SPAN, CFG)
    st.write_documents(bundle, str(tmp_path / "doc"))
    assert sorted(p.name for p in (tmp_path / "doc").iterdir()) == ["orders", "profile", "summary"]
    assert '"username":"-"' in _text(tmp_path / "doc" / "profile")


# --- snapshot ------------------------------------------------------------------------------


@pytest.mark.parametrize("with_events", [False, True])
def test_snapshot(spark, core, tmp_path, with_events):
    from pyspark.errors import AnalysisException

    def fetch(name):
        if name in cs.SCHEMAS:
            return getattr(core, name)
        if name == "app_events" and not with_events:
            raise AnalysisException("no such table")
        return spark.range(3)

    target = str(tmp_path / "copy")
    names = cs.snapshot_core(fetch, target)
    assert ("app_events" in names) == with_events
    assert set(cs.SNAPSHOT_TABLES) <= set(names)
    copied = cs.read_core(spark, target)
    for name in cs.SCHEMAS:
        day = f"{cs.EVENT_TIME[name]}_day"
        assert table(getattr(copied, name).drop(day)) == table(getattr(core, name))
    for name, build in marts.BUILDERS.items():
        assert table(build(copied, SPAN, CFG)) == table(build(core, SPAN, CFG)), name


def test_snapshot_tasks_hold_few_rows_of_a_heavy_day(spark, tmp_path, monkeypatch):
    """Rows that take next to nothing when compressed; by bytes they all came to one task."""
    monkeypatch.setattr(cs, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(cs, "FEW_ROWS", 100)
    when = "CASE WHEN id < 4000 THEN NULL ELSE timestamp_ntz'2024-01-01 00:00:00' END"
    made = spark.range(8000).selectExpr(
        "'o' AS order_id", "'u' AS user_id", f"{when} AS timestamp", f"{when} AS created_at",
        "CAST(1 AS INT) AS stars", "'paid' AS status")
    target = str(tmp_path / "copy")
    cs.snapshot_core(lambda n: made if n in cs.SCHEMAS else spark.range(1), target)
    copy = spark.read.parquet(f"{target}/orders")
    assert copy.where("timestamp IS NULL").count() == copy.where("timestamp IS NOT NULL").count() == 4000
    each = [r["count"] for r in copy.groupBy(F.input_file_name()).count().collect()]
    assert max(each) < 700 and len(each) >= 16


def test_foreign_types_are_read_as_declared(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql(
            "SELECT 7 AS order_id, 9.999D AS stars,"
            " timestamp'2024-01-01 00:00:00 UTC' AS created_at"
        )
        table = cs.CoreTables(lambda name: df).referral_earnings
        got = table.selectExpr("order_id", "stars", "string(created_at) AS t").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == ("7", 9, "2024-01-01 00:00:00")
    assert [f.dataType.simpleString() for f in table.schema] == ["string", "int", "timestamp_ntz"]


def test_command_line(spark, core, tmp_path):
    from martwright.__main__ import run

    source, target = str(tmp_path / "core"), str(tmp_path / "marts")
    cs.snapshot_core(
        lambda name: getattr(core, name) if name in cs.SCHEMAS else spark.range(1), source
    )
    base = ["--core", source, "--marts", target]
    run(spark, [*base, "backfill_full", "2024-01-01", "2024-02-29"])
    run(spark, [*base, "refresh", "today", "--as-of", "2024-02-29"])
    run(spark, [*base, "export", "daily", "2024-01-01", "2024-02-29", str(tmp_path / "out")])
    stored = MartStore(spark, target)
    assert stored.read("daily").count() == 60
    assert stored.runs().count() == 4
    assert (tmp_path / "out" / "metrics_daily_2024-01-01_2024-02-29.csv").exists()
    with pytest.raises(ValueError, match="`to` must be greater"):
        run(spark, [*base, "backfill_daily", "2024-02-29", "2024-01-01"])


def test_work_folder_is_the_cluster_s(spark):
    from martwright.operators.workdir import new_folder, shared_dir

    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert new_folder(spark, "x").startswith(f"{named}/x-")
