"""Requests: what may be asked, checked before any data is read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from quantwell.plans.contracts import Contracts, Metric
from quantwell.plans.errors import QueryError
from quantwell.plans.periods import LATEST, Period, default_period

#: Limits of a request and of an envelope.
MAX_DIMENSIONS, MAX_FILTERS, MAX_VALUES, MAX_ROWS, MAX_REQUESTS, MAX_CALCULATIONS, MAX_RUNS = 5, 12, 50, 100, 10, 10, 10
BUCKETS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
COMPARISONS = ("previous_period", "year_over_year", "snapshot_months_before")


@dataclass(frozen=True)
class Request:
    metric: str
    dimensions: tuple[str, ...] = ()
    filters: Mapping[str, object] = field(default_factory=dict)
    period: Period | None = None
    bucket: str | None = None
    comparison: str | None = None
    matched_elapsed: bool = False
    order_by: str | None = None
    descending: bool = True
    limit: int = MAX_ROWS
    decompose: str | None = None
    months_before: int = 1  #: of the comparison snapshot_months_before
    scope: str | None = None
    attribution: str | None = None


@dataclass(frozen=True)
class Checked:
    """A request with its period resolved and filter values normal."""

    request: Request
    metric: Metric
    period: Period | None
    filters: Mapping[str, tuple[object, ...]]


def check(request: Request, contracts: Contracts, observed: date) -> Checked:
    metric = contracts.metric(request.metric)
    contracts.require_available(request.metric)
    for what, n, most in (("dimensions", len(request.dimensions), MAX_DIMENSIONS), ("filters", len(request.filters), MAX_FILTERS)):
        if n > most:
            raise QueryError("INVALID_INPUT", f"{most} {what} at most", what)
    if len(set(request.dimensions)) != len(request.dimensions):
        raise QueryError("INVALID_INPUT", "a dimension stands twice", "dimensions")
    if not 1 <= request.limit <= MAX_ROWS:
        raise QueryError("INVALID_INPUT", f"1 to {MAX_ROWS} rows", "limit")
    if request.bucket is not None and request.bucket not in BUCKETS:
        raise QueryError("INVALID_INPUT", "buckets are days or months", "time_bucket")
    if request.comparison is not None and request.comparison not in COMPARISONS:
        raise QueryError("INVALID_INPUT", "no such comparison", "comparison")
    if request.comparison == "snapshot_months_before":
        if metric.default_period not in LATEST or request.period is not None or request.bucket is not None:
            raise QueryError("INVALID_INPUT", "only the latest snapshot is compared with one of months before", "comparison")
        if not 1 <= request.months_before <= 24:
            raise QueryError("INVALID_INPUT", "1 to 24 months before", "comparison")
    base = [contracts.metric(m) for m in contracts.parts(metric)] or [metric]
    for part in base:
        part.scoped(request.scope)
        if part.attribution_modes and request.attribution not in part.attribution_modes or not part.attribution_modes and request.attribution is not None:
            raise QueryError("ATTRIBUTION_MODE_MISMATCH", f"{part.name} is not kept by the ledger {request.attribution}", "attribution_mode")
    for d in request.dimensions:
        contracts.dimension(d, metric)
    if request.order_by is not None:
        if not request.dimensions and not request.bucket:
            raise QueryError("INVALID_INPUT", "a single value has no order", "order_by")
        known = {"metric_value", metric.name, *request.dimensions, "period"} | ({"delta_value", "absolute_delta_value", "change_rate", "comparison_value"} if request.comparison else set())
        if request.order_by not in known:
            raise QueryError("INVALID_INPUT", f"can't order by {request.order_by}", "order_by")
    filters = {}
    for name, value in request.filters.items():
        values = tuple(value) if isinstance(value, (list, tuple)) else (value,)
        if not 1 <= len(values) <= MAX_VALUES:
            raise QueryError("INVALID_INPUT", f"1 to {MAX_VALUES} values", name)
        filters[name] = tuple(contracts.dimension(name, metric).values.normal(v, name) for v in values)
    if metric.scope and metric.scope not in request.dimensions and len(filters.get(metric.scope, ())) != 1:
        raise QueryError(f"{'CURRENCY' if metric.scope == 'currency' else 'UNIT'}_SCOPE_REQUIRED", f"split by {metric.scope} or fix one", "dimensions")
    period = request.period or default_period(metric.default_period, observed)
    return Checked(request, metric, period, filters)


def check_envelope(requests: Mapping[str, Request], calculations: list[tuple[str, str, str]]) -> None:
    """Budgets of a batch, and calculations (operation, left, right) that name its requests."""
    if not 1 <= len(requests) <= MAX_REQUESTS or len(calculations) > MAX_CALCULATIONS:
        raise QueryError("INVALID_INPUT", "too many requests or calculations")
    if sum(2 if r.decompose else 1 for r in requests.values()) > MAX_RUNS:
        raise QueryError("EXECUTION_BUDGET_EXCEEDED", f"{MAX_RUNS} runs at most")
    for operation, left, right in calculations:
        if operation not in ("difference", "ratio", "share"):
            raise QueryError("CALCULATION_OPERATION_UNSUPPORTED", operation, "calculations")
        if left == right or left not in requests or right not in requests:
            raise QueryError("CALCULATION_REFERENCE_INVALID", f"{left}, {right}", "calculations")
