"""Half-open periods and the calendar: all on the driver, from an injected observation date."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

from quantwell.plans.errors import QueryError

#: Days that a period may span.
MAX_DAYS = 1096


def month_start(day: date) -> date:
    return day.replace(day=1)


def shift_months(day: date, months: int) -> date:
    """The same day of another month, or its last day if it has none such."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def iso_week(label: str) -> date:
    """The Monday of 'YYYY-Www'."""
    m = re.fullmatch(r"(\d{4})-W(\d{2})", label)
    try:
        return date.fromisocalendar(int(m[1]), int(m[2]), 1)
    except (TypeError, ValueError):
        raise QueryError("INVALID_INPUT", f"{label!r} is no ISO week", "baseline_week") from None


def iso_label(day: date) -> str:
    year, week, _ = day.isocalendar()
    return f"{year}-W{week:02d}"


@dataclass(frozen=True)
class Period:
    """start <= t < end."""

    start: date
    end: date

    def __post_init__(self):
        if not self.start < self.end:
            raise QueryError("INVALID_INPUT", "a period ends after it starts", "time_range")
        if (self.end - self.start).days > MAX_DAYS:
            raise QueryError("QUERY_RANGE_TOO_WIDE", f"a period spans {MAX_DAYS} days at most", "time_range")

    @property
    def days(self) -> int:
        return (self.end - self.start).days

    @property
    def whole_months(self) -> int | None:
        if self.start.day == self.end.day == 1:
            return (self.end.year - self.start.year) * 12 + self.end.month - self.start.month
        return None

    def previous(self) -> "Period":
        """The period before: as many months if both bounds are firsts of months, else as many days."""
        months = self.whole_months
        if months:
            return Period(shift_months(self.start, -months), self.start)
        return Period(self.start - timedelta(self.days), self.start)

    def year_before(self) -> "Period":
        return Period(shift_months(self.start, -12), shift_months(self.end, -12))

    def elapsed(self, observed: date) -> "Period":
        """Clipped to what has passed on the observation date, that day included."""
        end = min(self.end, observed + timedelta(1))
        if end <= self.start:
            raise QueryError("INVALID_INPUT", "the period has not begun", "time_range")
        return Period(self.start, end)

    def state(self, observed: date) -> str:
        if observed < self.start:
            return "not_started"
        return "completed" if observed >= self.end else "in_progress"


def of_month(label: str) -> Period:
    m = re.fullmatch(r"(\d{4})-(\d{2})", label)
    if not m or not 1 <= int(m[2]) <= 12:
        raise QueryError("INVALID_INPUT", f"{label!r} is no month", "calendar_month")
    first = date(int(m[1]), int(m[2]), 1)
    return Period(first, shift_months(first, 1))


#: Policies by which the data tells the month: the planner looks it up.
LATEST = ("latest_snapshot", "latest_non_null_snapshot")


def default_period(policy: str, observed: date) -> Period | None:
    """The period of a policy; None for current snapshots, which have no time filter, and where the data tells the month."""
    this = month_start(observed)
    if policy == "current_month":
        return Period(this, shift_months(this, 1))
    if policy in ("last_3_completed_months", "last_12_completed_months"):
        return Period(shift_months(this, -int(policy.split("_")[1])), this)
    if policy == "current_snapshot" or policy in LATEST:
        return None
    raise QueryError("INVALID_INPUT", "this metric needs a period", "time_range")
