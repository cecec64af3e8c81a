"""Local-time columns. Instants are TIMESTAMP_NTZ in UTC; results are the same in any session."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.ranges import DAY, DateRange


_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00"}


def _session_is_utc() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone") in _UTC_NAMES


def local_ts(ts: Column, zone: str) -> Column:
    """Wall time in ``zone``. Both forms give the same value.

    ``from_utc_timestamp`` resolves its zone once per task, ``convert_timezone`` once per row and
    at six times the cost, but only a UTC session reads a stored wall time as the UTC instant it
    is. The session zone is bound when the column is built into a frame.
    """
    if _session_is_utc():
        return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local_date(ts: Column, zone: str) -> Column:
    return local_ts(ts, zone).cast("date")


def week_start(date: Column) -> Column:
    return F.trunc(date, "week")


def week_age(week: Column, first_week: Column) -> Column:
    return (F.datediff(week, first_week) / F.lit(7)).cast("int")


def iso_weekday(ts: Column) -> Column:
    return F.weekday(ts) + F.lit(1)


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def instant(at: dt.datetime | None) -> Column:
    """Literal UTC wall time, free of any session or machine zone."""
    return F.lit(None if at is None else str(at)).cast("timestamp_ntz")


def day_begins(day: dt.date, zone: str) -> Column:
    """Stored instant at which local ``day`` begins. Folds to a literal."""
    midnight = F.lit(day).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight)


def _midnight_is_plain(day: dt.date, zone: str) -> bool:
    """Whether local midnight exists exactly once, so that one instant splits the two days."""
    midnight = dt.datetime.combine(day, dt.time(), ZoneInfo(zone))
    return midnight.utcoffset() == midnight.replace(fold=1).utcoffset()


def _bounds(
    df: DataFrame, ts: str, start: dt.date | None, end: dt.date, zone: str
) -> tuple[dict[str, Column], bool]:
    """Conditions on the time, on its stored form and on the day folder, as far as the table has
    them, and whether the first alone is exact."""
    raw, folder, stored = F.col(ts), f"{ts}_day", f"{ts}_instant"
    edges = [end + DAY] if start is None else [start, end + DAY]
    exact = all(_midnight_is_plain(edge, zone) for edge in edges)

    def both(column: Column, low, high) -> Column:
        return high(column) if start is None else high(column) & low(column)

    if exact:
        first = both(raw, lambda c: c >= day_begins(start, zone),
                     lambda c: c < day_begins(end + DAY, zone))
    else:
        first = both(raw, lambda c: c >= F.lit(start - DAY).cast("timestamp_ntz"),
                     lambda c: c < F.lit(end + 2 * DAY).cast("timestamp_ntz"))
    found = {ts: first}
    if stored in df.columns:
        # A zone-aware source: the stored column bears its own bounds, a day wider on either side.
        def midnight(day: dt.date) -> Column:
            return F.lit(dt.datetime.combine(day, dt.time(), dt.timezone.utc))

        found[stored] = both(F.col(stored), lambda c: c >= midnight(start - DAY),
                             lambda c: c < midnight(end + 2 * DAY))
    if folder in df.columns:
        found[folder] = both(F.col(folder), lambda c: c >= F.lit(start - DAY),
                             lambda c: c <= F.lit(end + DAY))
    return found, exact


def within(df: DataFrame, ts: str, rng: DateRange, zone: str, keep: str = "date") -> DataFrame:
    """Rows whose local date lies in ``rng``; the local date is added as ``keep``.

    The range is stated on the stored instant, where it reaches the files and costs no conversion
    per row; where the table is laid out in day folders (``<ts>_day``) it prunes folders too.
    Scattered days are stated piece by piece on each of these columns. Only a zone that repeats or
    skips one of the midnights needs a check of the converted date, and days too many to state.
    """
    told = [_bounds(df, ts, piece.start, piece.end, zone) for piece in rng.pieces]
    for column in told[0][0]:
        df = df.where(reduce(or_, [found[column] for found, _ in told]))
    kept = df.withColumn(keep, local_date(F.col(ts), zone))
    exact = rng.exact and all(plain for _, plain in told)
    return kept if exact else kept.where(rng.holds(F.col(keep)))


def up_to(df: DataFrame, ts: str, day: dt.date, zone: str, keep: str = "date") -> DataFrame:
    """All history up to and including local ``day``, with the local date as ``keep``."""
    found, exact = _bounds(df, ts, None, day, zone)
    kept = df.where(reduce(and_, found.values())).withColumn(keep, local_date(F.col(ts), zone))
    return kept if exact else kept.where(F.col(keep) <= F.lit(day))
