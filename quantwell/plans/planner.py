"""From a checked request to a DataFrame."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantwell.functions.text import meter
from quantwell.operators.aggregates import aggregate, composite
from quantwell.operators.compare import compare, compared, ratio
from quantwell.operators.joins import enrich, sized
from quantwell.plans.contracts import Contracts, Dimension, Metric, MetricJoin
from quantwell.plans.errors import QueryError
from quantwell.plans.periods import LATEST, Period, shift_months
from quantwell.plans.request import BUCKETS, Checked, Request, check
from quantwell.sources.tables import Tables


#: Column that tells the period (0) from the one it is compared with (1).
SIDE = "__side"


class Planner:
    """Plans requests against contracts over tables, as observed on one date."""

    def __init__(self, contracts: Contracts, tables: Tables, observed: date):
        self.contracts, self.tables, self.observed = contracts, tables, observed

    def plan(self, request: Request) -> DataFrame:
        """The answer, in its order and cut to limit + 1 rows, so that one row more tells of truncation."""
        checked = check(request, self.contracts, self.observed)
        keys = self._keys(checked)
        out = self.unlimited(request)
        if not keys:
            return out
        return out.orderBy(*self._order(checked, keys)).limit(request.limit + 1)

    def unlimited(self, request: Request) -> DataFrame:
        checked = check(request, self.contracts, self.observed)
        keys = self._keys(checked)
        now, metric = checked.period, checked.metric
        if request.comparison is None:
            return self._metric(metric, checked, (now,), keys)
        if request.comparison == "snapshot_months_before":
            now, before = self.latest_month(metric), self.latest_month(metric, request.months_before)
            if now is None:  # no snapshot at all: nothing on either side
                now, before = Period(self.observed, self.observed + timedelta(1)), Period(self.observed - timedelta(1), self.observed)
        elif now is None:
            raise QueryError("INVALID_INPUT", "a comparison needs a period", "comparison")
        elif request.comparison == "year_over_year":
            now = now.elapsed(self.observed) if request.matched_elapsed else now
            before = now.year_before()
        else:
            before = now.previous()
        if before.end > now.start:
            current, prior = (self._metric(metric, checked, (p,), keys) for p in (now, before))
            return compare(current, prior, keys, zero_if_absent=metric.numerator is None)
        both = self._metric(metric, checked, (now, before), [*keys, SIDE])  # one scan for both periods
        known = metric.numerator is None and (bool(keys) or metric.aggregation not in ("min", "max", "days_since_min"))
        return compared(both, keys, SIDE, zero_if_absent=known)

    def latest_month(self, metric: Metric, offset: int = 0) -> Period | None:
        """The month of the latest snapshot that has rows (known ones, if the policy asks for these), `offset` (0 to 24) months back.

        The metric's own filters bear on it, a user's don't. Runs a job.
        """
        if not 0 <= offset <= 24:
            raise QueryError("INVALID_INPUT", "0 to 24 months back", "comparison")
        needed = [metric.required_measure] if metric.default_period == "latest_non_null_snapshot" else []
        if needed == [None]:
            raise QueryError("CONTRACT_UNAVAILABLE", f"{metric.name} names no measure that its snapshot must know")
        rows = self.tables.scan(self.contracts.datasets[metric.dataset], list(dict.fromkeys([metric.time, *needed, *(f.column for f in metric.filters)])))
        for condition in [*(f.condition() for f in metric.filters), *(F.col(c).isNotNull() for c in needed)]:
            rows = rows.where(condition)
        last = rows.agg(F.max(metric.time)).first()[0]
        if last is None:
            return None
        first = shift_months(date(last.year, last.month, 1), -offset)
        return Period(first, shift_months(first, 1))

    def _keys(self, checked: Checked) -> list[str]:
        dims = [self.contracts.dimension(d, checked.metric) for d in checked.request.dimensions]
        keys = [alias for d in dims for alias in d.columns]
        if len(set(keys)) != len(keys):
            raise QueryError("INVALID_PLAN", "two dimensions have a column of one name", "dimensions")
        return keys + ["period"] * (checked.request.bucket is not None)

    def _order(self, checked: Checked, keys: list[str]) -> list[Column]:
        r = checked.request
        name = r.order_by or ("delta_value" if r.comparison else "period" if r.bucket else "metric_value")
        down = r.descending if r.order_by else name != "period"
        name = "metric_value" if name == checked.metric.name else name
        column = F.abs("delta_value") if name == "absolute_delta_value" else F.col(name)
        return [column.desc_nulls_last() if down else column.asc_nulls_first(), *(F.col(k).asc_nulls_first() for k in keys)]

    def _metric(self, metric: Metric, checked: Checked, periods: tuple[Period | None, ...], keys: list[str]) -> DataFrame:
        part = lambda name: self._metric(self.contracts.metric(name), checked, periods, keys)
        if metric.components:
            if any(self.contracts.metric(m).components for _, m in metric.components):
                raise QueryError("INVALID_PLAN", "composites are made of base metrics")
            return composite([(sign, part(m)) for sign, m in metric.components], keys)
        if metric.numerator:
            return ratio(part(metric.numerator), part(metric.denominator), keys, metric.denominator_policy)
        return self._base(metric, checked, periods, keys)

    def _base(self, metric: Metric, checked: Checked, periods: tuple[Period | None, ...], keys: list[str]) -> DataFrame:
        contracts, source = self.contracts, self.contracts.datasets[metric.dataset]
        dims = {d: contracts.dimension(d, metric) for d in (*checked.request.dimensions, *checked.filters)}
        df = self.tables.scan(source)
        conditions = [f.condition() for f in contracts.refined(metric, metric.scoped(checked.request.scope))]
        if periods == (None,) and metric.default_period in LATEST:
            month = self.latest_month(metric)
            periods = (month,)
            conditions += [F.lit(False)] if month is None else []
        inside = []
        for period in periods:
            if period is not None:
                if metric.time is None:
                    raise QueryError("INVALID_INPUT", f"{metric.name} has no time", "time_range")
                t = F.col(metric.time)
                inside.append((t >= F.lit(period.start)) & (t < F.lit(period.end)))
        if inside:
            conditions.append(reduce(lambda a, b: a | b, inside))
        own = {n: d for n, d in dims.items() if d.dataset is None}
        conditions += [self._matches(d, F.col(d.filter_column), checked.filters[n]) for n, d in own.items() if n in checked.filters]
        if conditions:  # before any join, so that the scan gets them
            df = df.where(reduce(lambda a, b: a & b, conditions))
        joined: dict[tuple[str, ...], str] = {}
        places: dict[str, str] = {}
        for name, d in dims.items():
            if d.dataset is not None:
                df, places[name] = self._joined(df, metric.dataset, d, joined)
        for name, values in checked.filters.items():
            if name in places:
                df = df.where(self._matches(dims[name], F.col(places[name] + dims[name].filter_column), values))
        for j in metric.joins:
            df = self._needed(df, j)
        shown = [F.col(places.get(n, "") + column).alias(alias) for n in checked.request.dimensions for alias, column in dims[n].columns.items()]
        shown = [meter(c).alias(alias) if dims[n].meter else c for c, (n, alias) in zip(shown, ((n, a) for n in checked.request.dimensions for a in dims[n].columns), strict=True)]
        if checked.request.bucket:
            shown.append(F.date_format(metric.time, BUCKETS[checked.request.bucket]).alias("period"))
        if SIDE in keys:
            shown.append(F.when(inside[0], 0).otherwise(1).alias(SIDE))
        inputs = [*metric.measures, *([metric.multiplier] if metric.multiplier else [])]
        facts = df.select(*shown, *(F.col(c).alias(f"__m{i}") for i, c in enumerate(inputs)))
        measures = [F.col(f"__m{i}") for i in range(len(metric.measures))]
        multiplier = F.col(f"__m{len(inputs) - 1}") if metric.multiplier else None
        return aggregate(facts, keys, metric.aggregation, measures, multiplier, self.observed)

    def _needed(self, df: DataFrame, j: MetricJoin) -> DataFrame:
        """A metric's own join: facts that find a row, or that find none."""
        target = self.contracts.datasets[j.target]
        if tuple(sorted(j.target_columns)) not in {tuple(sorted(k)) for k in target.unique_keys}:
            raise QueryError("INVALID_PLAN", f"{j.target} has no such unique key: rows could multiply")
        side = self.tables.scan(target)
        if j.required_missing:
            renamed = side.select(*(F.col(c).alias(f"__n{i}") for i, c in enumerate(j.target_columns)))
            return df.join(sized(renamed), reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__n{i}") for i, c in enumerate(j.columns))), "left_anti")
        more = {c: c for c in target.columns if c not in df.columns}
        df = enrich(df, side, dict(zip(j.columns, j.target_columns, strict=True)), more)
        for condition in [*(f.condition() for f in j.required), *(F.col(c).isNotNull() for c in j.required_not_null)]:
            df = df.where(condition)  # on the joined rows: an outer join that is narrowed becomes an inner one
        return df

    def _matches(self, d: Dimension, column: Column, values: tuple) -> Column:
        if d.meter:
            column, values = meter(column), tuple("m" if str(v).lower() == "m" else v for v in values)
        return column.isin(list(values)) if len(values) > 1 else column == values[0]

    def _joined(self, df: DataFrame, source: str, d: Dimension, joined: dict) -> tuple[DataFrame, str]:
        """Follows a dimension's way from master to master; a way taken before isn't joined again."""
        at, prefix, way = source, "", ()
        for target in (*d.via, d.dataset):
            way = (*way, target)
            join = self.contracts.join(at, target)
            if way not in joined:
                joined[way] = f"__{len(joined)}_"
                side = self.contracts.datasets[target]
                df = enrich(df, self.tables.scan(side), {prefix + a: b for a, b in zip(join.columns, join.target_columns, strict=True)}, {joined[way] + c: c for c in side.columns})
            at, prefix = target, joined[way]
        return df, prefix


def decomposition(planner: Planner, request: Request) -> DataFrame:
    """A complete decomposition of a change by the request's `decompose` dimension."""
    from quantwell.operators.compare import decompose

    whole = planner.unlimited(replace(request, dimensions=(), decompose=None))
    parts = planner.unlimited(replace(request, dimensions=(request.decompose,), decompose=None))
    return decompose(parts, whole)
