"""Contracts: which tables, columns, joins, dimensions and metrics a request may use."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantwell.plans.errors import QueryError

# The names of operators, aggregations and policies are those of the contract documents.

#: Operators of fixed filters.
FILTER_OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in")
#: Base aggregations.
AGGREGATIONS = (
    "sum", "sum_product", "sum_product_many", "count_distinct", "sum_positive", "min", "max", "days_since_min",
    "max_days_over", "sum_positive_difference", "sum_positive_difference_product",
)


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: object

    def __post_init__(self):
        if self.operator not in FILTER_OPERATORS:
            raise QueryError("INVALID_PLAN", f"unknown operator {self.operator}")
        if self.operator == "in" and not 1 <= len(self.value) <= 50:
            raise QueryError("INVALID_PLAN", "a list has 1 to 50 values", self.column)

    def condition(self) -> Column:
        c = F.col(self.column)
        if self.operator == "in":
            return c.isin(list(self.value))
        return {"eq": c == self.value, "ne": c != self.value, "gt": c > self.value, "gte": c >= self.value, "lt": c < self.value, "lte": c <= self.value}[self.operator]


@dataclass(frozen=True)
class Join:
    """A many-to-one join: `columns` of this dataset to a declared unique key of `target`."""

    target: str
    columns: tuple[str, ...]
    target_columns: tuple[str, ...]


@dataclass(frozen=True)
class Dataset:
    name: str
    table: str
    columns: tuple[str, ...]
    kind: str = "fact"
    unique_keys: tuple[tuple[str, ...], ...] = ()
    required: tuple[Filter, ...] = ()
    joins: tuple[Join, ...] = ()
    #: name to expression, for columns that the table doesn't store as they are asked for.
    derived: Mapping[str, str] = field(default_factory=dict)
    blocked: tuple[str, ...] = ()


@dataclass(frozen=True)
class ValueContract:
    """Which filter values a dimension takes: any, or those of a closed list with aliases."""

    allowed: tuple[object, ...] | None = None
    aliases: Mapping[str, object] = field(default_factory=dict)

    def normal(self, value: object, path: str) -> object:
        value = self.aliases.get(value, value) if isinstance(value, str) else value
        if self.allowed is not None and not any(type(a) is type(value) and a == value for a in self.allowed):
            raise QueryError("FILTER_VALUE_NOT_ALLOWED", f"{value!r} is not a value of this dimension", path)
        return value


@dataclass(frozen=True)
class Dimension:
    """Output columns of a dimension: alias to column, of the fact or of `dataset` joined to it."""

    name: str
    columns: Mapping[str, str]
    filter_column: str
    dataset: str | None = None
    via: tuple[str, ...] = ()
    values: ValueContract = ValueContract()
    meter: bool = False


def refines(inherited: Filter, own: Filter) -> bool:
    """Whether a metric's filter only narrows the dataset's on the same column: equal to it, or within its list."""
    if own == inherited:
        return True
    if inherited.operator != "in":
        return False
    return own.value in inherited.value if own.operator == "eq" else own.operator == "in" and bool(own.value) and set(own.value) <= set(inherited.value)


@dataclass(frozen=True)
class MetricJoin:
    """A join that a metric needs: rows of `target` that pass `required` (these narrow the result).

    required_not_null: columns of the target that a fact must find. required_missing: facts that find
    a row leave instead. The target's columns are measures under their own names.
    """

    target: str
    columns: tuple[str, ...]
    target_columns: tuple[str, ...]
    required: tuple[Filter, ...] = ()
    required_not_null: tuple[str, ...] = ()
    required_missing: bool = False

    def __post_init__(self):
        if self.required_missing and (self.required or self.required_not_null):
            raise QueryError("INVALID_PLAN", "a join is for present or for missing rows, not for both")


@dataclass(frozen=True)
class Metric:
    """A base metric (aggregation of a dataset), a composite of signed metrics or a ratio of two."""

    name: str
    dataset: str | None = None
    aggregation: str | None = None
    measures: tuple[str, ...] = ()
    multiplier: str | None = None
    time: str | None = None
    filters: tuple[Filter, ...] = ()
    components: tuple[tuple[int, str], ...] = ()
    numerator: str | None = None
    denominator: str | None = None
    denominator_policy: str = "positive"
    default_period: str = "required"
    scope: str | None = None  #: dimension by which values must be split or fixed, as a currency or a unit
    available: bool = True
    dimensions: tuple[str, ...] = ()
    required_measure: str | None = None  #: column that a month must know somewhere to be the latest non-null snapshot
    scopes: Mapping[str, tuple[Filter, ...]] = field(default_factory=dict)  #: named parts of a stock, by the filters that fix them
    default_scope: str = "total"
    attribution_modes: tuple[str, ...] = ()  #: ledgers by which a request may attribute values; none: it must not say
    joins: tuple[MetricJoin, ...] = ()

    def scoped(self, scope: str | None) -> tuple[Filter, ...]:
        """The metric's filters with those of a scope; a scope must not contradict them."""
        if not self.scopes:
            if scope is not None:
                raise QueryError("INVALID_PLAN", f"{self.name} has no scopes", "inventory_scope")
            return self.filters
        if (scope or self.default_scope) not in self.scopes:
            raise QueryError("INVALID_PLAN", f"{self.name} has no such scope", "inventory_scope")
        more = self.scopes[scope or self.default_scope]
        fixed = {f.column: f for f in self.filters}
        if any(f.column in fixed and fixed[f.column] != f for f in more):
            raise QueryError("CONTRACT_UNAVAILABLE", f"a scope of {self.name} contradicts its filters")
        return (*self.filters, *(f for f in more if f.column not in fixed))


@dataclass(frozen=True)
class Contracts:
    datasets: Mapping[str, Dataset]
    dimensions: Mapping[str, Dimension]
    metrics: Mapping[str, Metric]

    def metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise QueryError("UNSUPPORTED_METRIC", f"no metric {name}", "metric")
        return self.metrics[name]

    def dimension(self, name: str, metric: Metric) -> Dimension:
        if name not in self.dimensions or metric.dimensions and name not in metric.dimensions:
            raise QueryError("UNSUPPORTED_DIMENSION", f"{metric.name} has no dimension {name}", "dimensions")
        return self.dimensions[name]

    def parts(self, metric: Metric) -> list[str]:
        return [*(m for _, m in metric.components), *(m for m in (metric.numerator, metric.denominator) if m)]

    def require_available(self, name: str, above: tuple[str, ...] = ()) -> None:
        """The metric and all it is made of must be available, and not be made of itself."""
        if name in above:
            raise QueryError("CONTRACT_UNAVAILABLE", " -> ".join((*above, name)))
        metric = self.metric(name)
        if not metric.available:
            raise QueryError("CONTRACT_UNAVAILABLE", f"{name} is not available yet")
        for part in self.parts(metric):
            self.require_available(part, (*above, name))

    def join(self, source: str, target: str) -> Join:
        """The declared join; its target columns must be a declared unique key."""
        for j in self.datasets[source].joins:
            if j.target == target:
                if tuple(sorted(j.target_columns)) not in {tuple(sorted(k)) for k in self.datasets[target].unique_keys}:
                    raise QueryError("INVALID_PLAN", f"{target} has no such unique key: rows could multiply")
                return j
        raise QueryError("INVALID_PLAN", f"{source} does not join {target}")

    def refined(self, metric: Metric, filters: tuple[Filter, ...]) -> tuple[Filter, ...]:
        """The filters, none of which may widen or contradict what its dataset requires of the column."""
        for own in filters:
            for inherited in self.datasets[metric.dataset].required:
                if inherited.column == own.column and not refines(inherited, own):
                    raise QueryError("INVALID_PLAN", f"{metric.name} must only narrow the filter on {own.column}")
        return filters

    def digest(self) -> str:
        """A digest of what the contracts say, for pinning."""
        return hashlib.sha256(json.dumps({k: {n: asdict(x) for n, x in sorted(getattr(self, k).items())} for k in ("datasets", "dimensions", "metrics")}, sort_keys=True, default=str).encode()).hexdigest()


def load(document: Mapping) -> Contracts:
    """Contracts from a parsed document (YAML or JSON): lists under datasets, dimensions and metrics."""
    filters = lambda x: tuple(Filter(f["column"], f["operator"], tuple(f["value"]) if f["operator"] == "in" else f["value"]) for f in x or ())
    tuples = lambda x: tuple(tuple(v) if isinstance(v, list) else v for v in x or ())
    make: dict[str, Callable] = {
        "datasets": lambda d: Dataset(**{**d, "columns": tuple(d["columns"]), "unique_keys": tuples(d.get("unique_keys")), "required": filters(d.get("required")), "joins": tuple(Join(j["target"], tuple(j["columns"]), tuple(j["target_columns"])) for j in d.get("joins", ())), "blocked": tuple(d.get("blocked", ()))}),
        "dimensions": lambda d: Dimension(**{**d, "via": tuple(d.get("via", ())), "values": ValueContract(tuple(d["values"]["allowed"]) if "allowed" in d.get("values", {}) else None, d.get("values", {}).get("aliases", {}))}),
        "metrics": lambda d: Metric(**{**d, "measures": tuple(d.get("measures", ())), "filters": filters(d.get("filters")), "components": tuples(d.get("components")), "dimensions": tuple(d.get("dimensions", ()))}),
    }
    found: dict[str, dict] = {}
    for kind, build in make.items():
        found[kind] = {}
        for entry in document.get(kind, ()):
            if entry["name"] in found[kind]:
                raise QueryError("CONTRACT_UNAVAILABLE", f"{kind}: {entry['name']} stands twice")
            found[kind][entry["name"]] = build(entry)
    return Contracts(**found)
