import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from martwright.ranges import DateRange, cohort_window, monday, refresh_window, runs_of
from martwright.operators.frames import clamp_limit
from martwright.settings import Settings

AS_OF = dt.date(2011, 3, 30)
days = st.dates(dt.date(2000, 1, 1), dt.date(2030, 1, 1))


def test_defaults_cover_thirty_days():
    rng = DateRange.parse(None, "", AS_OF)
    assert (rng.start, rng.end, rng.days) == (dt.date(2011, 3, 1), AS_OF, 30)


def test_unreadable_dates_fall_back():
    assert DateRange.parse("soon", "2011-13-40", AS_OF) == DateRange.parse(None, None, AS_OF)


def test_reversed_range_is_refused_unless_allowed():
    with pytest.raises(ValueError, match="`to` must be greater"):
        DateRange.parse("2011-03-30", "2011-03-01", AS_OF)
    assert DateRange.parse("2011-03-30", "2011-03-01", AS_OF, ordered=False).days == 0


def test_previous_period():
    before = DateRange(dt.date(2011, 3, 1), AS_OF).previous()
    assert (before.start, before.end) == (dt.date(2011, 1, 30), dt.date(2011, 2, 28))


@given(days, st.integers(0, 400))
def test_previous_has_equal_length_and_touches(start, n):
    rng = DateRange(start, start + dt.timedelta(days=n))
    before = rng.previous()
    assert before.days == rng.days
    assert before.end + dt.timedelta(days=1) == rng.start


@given(days)
def test_monday(day):
    assert monday(day).weekday() == 0
    assert 0 <= (day - monday(day)).days < 7


@given(st.lists(days, max_size=30))
def test_runs_hold_exactly_the_days(listed):
    runs = runs_of(listed)
    covered = [r.start + dt.timedelta(days=i) for r in runs for i in range(r.days)]
    assert covered == sorted(set(listed))


def test_refresh_windows():
    assert refresh_window("today", AS_OF).days == 1
    assert refresh_window("last_3_days", AS_OF).start == dt.date(2011, 3, 28)
    assert refresh_window("last_30_days", AS_OF).start == dt.date(2011, 3, 1)
    assert refresh_window("anything else", AS_OF).days == 1
    assert cohort_window(AS_OF).start == AS_OF - dt.timedelta(days=84)


def test_limits():
    assert [clamp_limit(x) for x in (None, 0, -5, 7, "12", 99999)] == [200, 1, 1, 7, 12, 1000]


def test_settings():
    cfg = Settings(statuses={"paid": ["done", "", None], "failed": []}, gift_default_cost=-3)
    assert cfg.paid == ["done"]
    assert cfg.failed == ["failed"]
    assert cfg.gift_default_cost == Decimal("0.00")
    assert "SUCCEEDED" in cfg.payment_success and "done" in cfg.payment_success


def test_today_is_the_business_day():
    late = Settings(clock=lambda: dt.datetime(2011, 3, 30, 21, 30))
    assert late.today() == dt.date(2011, 3, 31)
