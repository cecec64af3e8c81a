"""Inclusive calendar ranges; all date arithmetic that is known before a query runs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = dt.timedelta(days=1)


def monday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def parse_day(text: str | dt.date | None) -> dt.date | None:
    """ISO date, or None for blanks and anything unreadable."""
    if isinstance(text, dt.date):
        return text
    try:
        return dt.date.fromisoformat(text) if text and text.strip() else None
    except ValueError:
        return None


@dataclass(frozen=True)
class DateRange:
    start: dt.date
    end: dt.date
    ordered: bool = True

    def __post_init__(self) -> None:
        if self.ordered and self.end < self.start:
            raise ValueError("`to` must be greater than or equal to `from`")

    @classmethod
    def parse(cls, start, end, as_of: dt.date, days: int = 30, ordered: bool = True) -> DateRange:
        """Range from request texts; missing ends default to the ``days`` ending at ``as_of``."""
        first = parse_day(start) or as_of - DAY * (days - 1)
        return cls(first, parse_day(end) or as_of, ordered)

    @classmethod
    def last(cls, days: int, as_of: dt.date) -> DateRange:
        return cls(as_of - DAY * (days - 1), as_of)

    @classmethod
    def one_day(cls, day: dt.date) -> DateRange:
        return cls(day, day)

    @property
    def days(self) -> int:
        return max(0, (self.end - self.start).days + 1)

    @property
    def week_count(self) -> int:
        return (monday(self.end) - monday(self.start)).days // 7 + 1

    @property
    def pieces(self) -> tuple[DateRange, ...]:
        """Contiguous ranges that cover the days."""
        return (self,)

    @property
    def exact(self) -> bool:
        """Whether the pieces hold no other day."""
        return True

    def months(self) -> list[dt.date]:
        """First days of the months that the pieces touch."""
        found = set()
        for piece in self.pieces:
            month = month_start(piece.start)
            while month <= piece.end:
                found.add(month)
                month = month_start(month + 31 * DAY)
        return sorted(found)

    def whole_months(self) -> DateRange:
        """All days of the months that the pieces touch."""
        days = [month + i * DAY for month in self.months() for i in range(31)
                if (month + i * DAY).month == month.month]
        runs = runs_of(days)
        return runs[0] if len(runs) == 1 else DaySet.of(days)

    def weeks(self) -> DateRange:
        """Both ends moved back to their Monday."""
        return DateRange(monday(self.start), monday(self.end), self.ordered)

    def previous(self) -> DateRange:
        """Range of equal length that ends the day before this one starts."""
        return DateRange(self.start - DAY * max(1, self.days), self.start - DAY)

    def holds(self, date_col):
        return date_col.between(F.lit(self.start), F.lit(self.end))

    def spine(self, spark: SparkSession) -> DataFrame:
        """One row per day; the row count is known here, so a single task is enough."""
        span = max(0, (self.end - self.start).days + 1)
        return spark.range(0, span, 1, 1).select(
            F.date_add(F.lit(self.start), F.col("id").cast("int")).alias("date")
        )


def runs_of(days: list[dt.date]) -> list[DateRange]:
    """Touched days as the fewest contiguous ranges."""
    out: list[DateRange] = []
    for day in sorted(set(days)):
        if out and day - out[-1].end == DAY:
            out[-1] = DateRange(out[-1].start, day)
        else:
            out.append(DateRange.one_day(day))
    return out


#: A scan is told of at most this many ranges; days beyond are told apart by a set of dates.
MOST_PIECES = 64


@dataclass(frozen=True)
class DaySet(DateRange):
    """Scattered days. ``start`` and ``end`` are the outermost; days between are not meant."""

    listed: frozenset[dt.date] = frozenset()

    @classmethod
    def of(cls, days: list[dt.date]) -> DaySet:
        return cls(min(days), max(days), True, frozenset(days))

    @property
    def days(self) -> int:
        return len(self.listed)

    @property
    def pieces(self) -> tuple[DateRange, ...]:
        """The runs of days; where they are too many, those with the smallest gaps are one."""
        runs = runs_of(list(self.listed))
        if len(runs) <= MOST_PIECES:
            return tuple(runs)
        gaps = sorted(range(1, len(runs)), key=lambda i: runs[i].start - runs[i - 1].end)
        cuts = sorted(gaps[-(MOST_PIECES - 1):])
        edges = zip([0, *cuts], [*cuts, len(runs)])
        return tuple(DateRange(runs[a].start, runs[b - 1].end) for a, b in edges)

    @property
    def exact(self) -> bool:
        return sum(p.days for p in self.pieces) == len(self.listed)

    def holds(self, date_col):
        return date_col.isin([F.lit(day) for day in sorted(self.listed)])

    def spine(self, spark: SparkSession) -> DataFrame:
        return super().spine(spark).where(self.holds(F.col("date")))


# Refresh modes: number of days that end at the as-of day. Fixed values.
REFRESH_DAYS = {"today": 1, "last_3_days": 3, "last_30_days": 30}
COHORT_LOOKBACK_DAYS = 84


def refresh_window(mode: str, as_of: dt.date) -> DateRange:
    return DateRange.last(REFRESH_DAYS.get(mode, 1), as_of)


def cohort_window(as_of: dt.date) -> DateRange:
    return DateRange(as_of - DAY * COHORT_LOOKBACK_DAYS, as_of)
