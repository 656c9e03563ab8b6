"""Contracts, periods, requests and driver-side evidence: no data is read."""

from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest

from quantwell.commerce import OBSERVED, contracts
from quantwell.operators import evidence
from quantwell.plans import contracts as C
from quantwell.plans.errors import QueryError
from quantwell.plans.periods import MAX_DAYS, Period, default_period, iso_label, iso_week, of_month, shift_months
from quantwell.plans.request import Request, check, check_envelope

MARCH = Period(date(2000, 3, 1), date(2000, 4, 1))


def code(f, *args):
    with pytest.raises(QueryError) as e:
        f(*args)
    return e.value.code


def test_months_shift_and_clamp():
    assert shift_months(date(2000, 3, 31), -1) == date(2000, 2, 29)
    assert shift_months(date(2000, 1, 31), 13) == date(2001, 2, 28)
    assert shift_months(date(2000, 1, 5), -1) == date(1999, 12, 5)


def test_periods():
    assert MARCH.previous() == Period(date(2000, 2, 1), date(2000, 3, 1))
    assert Period(date(2000, 3, 5), date(2000, 3, 8)).previous() == Period(date(2000, 3, 2), date(2000, 3, 5))
    assert Period(date(2000, 2, 29), date(2000, 3, 1)).year_before() == Period(date(1999, 2, 28), date(1999, 3, 1))
    assert Period(date(2000, 6, 1), date(2000, 7, 1)).elapsed(OBSERVED).end == date(2000, 6, 16)
    assert [MARCH.state(d) for d in (date(2000, 2, 29), date(2000, 3, 31), date(2000, 4, 1))] == ["not_started", "in_progress", "completed"]
    assert code(Period, date(2000, 1, 1), date(2000, 1, 1)) == "INVALID_INPUT"
    assert Period(date(2000, 1, 1), date.fromordinal(date(2000, 1, 1).toordinal() + MAX_DAYS)).days == MAX_DAYS
    assert code(Period, date(2000, 1, 1), date.fromordinal(date(2000, 1, 1).toordinal() + MAX_DAYS + 1)) == "QUERY_RANGE_TOO_WIDE"


def test_default_periods_and_labels():
    assert default_period("current_month", OBSERVED) == Period(date(2000, 6, 1), date(2000, 7, 1))
    assert default_period("last_3_completed_months", OBSERVED) == Period(date(2000, 3, 1), date(2000, 6, 1))
    assert default_period("current_snapshot", OBSERVED) is None
    assert code(default_period, "required", OBSERVED) == "INVALID_INPUT"
    assert of_month("2000-02") == Period(date(2000, 2, 1), date(2000, 3, 1)) and code(of_month, "2000-13") == "INVALID_INPUT"
    assert iso_label(date(2021, 1, 3)) == "2020-W53" and iso_week("2020-W53") == date(2020, 12, 28) and code(iso_week, "2021-W53") == "INVALID_INPUT"


@pytest.mark.parametrize(
    "change,error",
    [
        ({"metric": "nothing"}, "UNSUPPORTED_METRIC"),
        ({"metric": "planned_amount"}, "CONTRACT_UNAVAILABLE"),
        ({"dimensions": ("colour",)}, "UNSUPPORTED_DIMENSION"),
        ({"dimensions": ("region", "region")}, "INVALID_INPUT"),
        ({"filters": {"status": "X"}}, "FILTER_VALUE_NOT_ALLOWED"),
        ({"filters": {"status": []}}, "INVALID_INPUT"),
        ({"filters": {"nation": ["n"] * 51}}, "INVALID_INPUT"),
        ({"limit": 101}, "INVALID_INPUT"),
        ({"bucket": "year"}, "INVALID_INPUT"),
        ({"order_by": "metric_value"}, "INVALID_INPUT"),
        ({"dimensions": ("region",), "order_by": "delta_value"}, "INVALID_INPUT"),
        ({"metric": "delivered_quantity"}, "UNIT_SCOPE_REQUIRED"),
        ({"metric": "delivered_quantity", "filters": {"unit": ["a", "b"]}}, "UNIT_SCOPE_REQUIRED"),
        ({"scope": "open"}, "INVALID_PLAN"),
        ({"metric": "stock_quantity", "period": None, "scope": "allocated"}, "INVALID_PLAN"),
        ({"attribution": "shared"}, "ATTRIBUTION_MODE_MISMATCH"),
        ({"metric": "ledger_amount"}, "ATTRIBUTION_MODE_MISMATCH"),
        ({"comparison": "snapshot_months_before"}, "INVALID_INPUT"),
        ({"metric": "latest_orders", "period": None, "comparison": "snapshot_months_before", "months_before": 25}, "INVALID_INPUT"),
    ],
)
def test_requests_that_are_refused(change, error):
    assert code(check, replace(Request("gross_amount", period=MARCH), **change), contracts(), OBSERVED) == error


def test_values_become_normal():
    assert check(Request("gross_amount", filters={"status": "final"}), contracts(), OBSERVED).filters == {"status": ("F",)}
    assert check(Request("delivered_quantity", filters={"unit": "Brand#12"}), contracts(), OBSERVED).period == Period(date(2000, 3, 1), date(2000, 6, 1))
    assert C.ValueContract((1,)).normal(1, "") == 1 and code(C.ValueContract((1,)).normal, True, "") == "FILTER_VALUE_NOT_ALLOWED"


def test_envelopes():
    r = Request("gross_amount", period=MARCH)
    check_envelope({"a": r, "b": r}, [("ratio", "a", "b")])
    assert code(check_envelope, {}, []) == "INVALID_INPUT"
    assert code(check_envelope, {str(k): replace(r, decompose="region") for k in range(6)}, []) == "EXECUTION_BUDGET_EXCEEDED"
    assert code(check_envelope, {"a": r}, [("ratio", "a", "a")]) == "CALCULATION_REFERENCE_INVALID"
    assert code(check_envelope, {"a": r, "b": r}, [("power", "a", "b")]) == "CALCULATION_OPERATION_UNSUPPORTED"


def test_joins_need_a_unique_key_and_metrics_no_cycle():
    own = contracts()
    loose = replace(own, datasets={**own.datasets, "part": replace(own.datasets["part"], unique_keys=())})
    assert code(loose.join, "delivery", "part") == "INVALID_PLAN" and code(own.join, "delivery", "region") == "INVALID_PLAN"
    round_ = replace(own, metrics={"a": C.Metric("a", components=((1, "b"),)), "b": C.Metric("b", numerator="a", denominator="a")})
    assert code(round_.require_available, "a") == "CONTRACT_UNAVAILABLE"


def test_contracts_load_from_documents():
    document = {
        "datasets": [{"name": "f", "table": "t", "columns": ["k", "v"], "joins": [{"target": "m", "columns": ["k"], "target_columns": ["k"]}], "required": [{"column": "k", "operator": "in", "value": [1, 2]}]}, {"name": "m", "table": "u", "columns": ["k"], "unique_keys": [["k"]]}],
        "dimensions": [{"name": "d", "columns": {"d": "k"}, "filter_column": "k", "dataset": "m", "values": {"allowed": [1], "aliases": {"one": 1}}}],
        "metrics": [{"name": "x", "dataset": "f", "aggregation": "sum", "measures": ["v"]}],
    }
    found = C.load(document)
    assert found.join("f", "m").columns == ("k",) and found.dimensions["d"].values.normal("one", "") == 1
    assert found.digest() == C.load(document).digest() != contracts().digest()
    assert code(C.load, {"metrics": document["metrics"] * 2}) == "CONTRACT_UNAVAILABLE"
    assert code(C.Filter, "k", "in", ()) == "INVALID_PLAN" and code(C.Filter, "k", "like", "x") == "INVALID_PLAN"


def test_evidence():
    d = Decimal
    assert evidence.calculate("difference", d(3), d(5)) == -2 and evidence.calculate("ratio", d(3), d(0)) is None and evidence.calculate("ratio", None, d(1)) is None
    assert evidence.calculate("share", d(1), d(4), subset=True) == d("0.25")
    assert code(evidence.calculate, "share", d(1), d(4)) == "CALCULATION_SCOPE_INCOMPATIBLE"
    assert evidence.ranking([d(1), d(3), d(3)], True)["unique_top_proven"] is False and evidence.ranking([d(1), d(3)], True)["unique_top_proven"]
    assert not evidence.ranking([d(1), None], True)["unique_top_proven"]
    months = {"a": d(1), "b": d(3), "c": None}
    assert evidence.period_summary(months, ["a"], {"a", "b"}, True)["ratio"] == d("0.25") and evidence.period_summary(months, ["a"], {"a", "c"}, True)["ratio"] is None
    assert code(evidence.period_summary, months, ["a"], {"a"}, False) == "NONADDITIVE_PERIOD_FIELD"
    assert evidence.fingerprint({"b": 1, "a": 2}) == evidence.fingerprint({"a": 2, "b": 1})
    assert evidence.report_gate([{"data_state": "rows"}, {"truncated": True}, {"data_state": "incomplete"}, {"error": "X"}]) == ["1: truncated", "2: incomplete", "3: X"]


def test_filters_only_narrow():
    own = contracts()
    f = C.Filter
    assert C.refines(f("k", "in", (1, 2)), f("k", "eq", 1)) and C.refines(f("k", "in", (1, 2)), f("k", "in", (2,))) and C.refines(f("k", "gt", 1), f("k", "gt", 1))
    assert not C.refines(f("k", "in", (1, 2)), f("k", "eq", 3)) and not C.refines(f("k", "in", (1, 2)), f("k", "in", (2, 3))) and not C.refines(f("k", "gt", 1), f("k", "gt", 2))
    assert code(own.refined, own.metrics["returned_settled"], (f("l_returnflag", "eq", "N"),)) == "INVALID_PLAN"
    clash = replace(own.metrics["stock_quantity"], filters=(f("l_linestatus", "eq", "F"),))
    assert code(clash.scoped, "open") == "CONTRACT_UNAVAILABLE" and len(clash.scoped("returned")) == 2
    assert code(C.MetricJoin, "part", ("a",), ("b",), (f("k", "eq", 1),), (), True) == "INVALID_PLAN"


def test_evidence_of_reports():
    d = Decimal
    assert evidence.snapshot_month([{"snapshot_month": "2026-01"}, {"snapshot_month": None}, {"snapshot_month": "2026-01-31"}]) == "2026-01"
    assert evidence.snapshot_month([]) is None and code(evidence.snapshot_month, [{"snapshot_month": "2026-01"}, {"snapshot_month": "2026-02"}]) == "CONTRACT_UNAVAILABLE"
    states = [evidence.gap_ratio(*x)["value_state"] for x in ((d(1), d(4), "CNY", "CNY"), (d(1), d(4), "CNY", None), (None, d(4), "CNY", "CNY"), (d(1), d(0), "CNY", "CNY"))]
    assert states == ["available", "unit_unverified", "missing_input", "zero_denominator"] and evidence.gap_ratio(d(1), d(4), "CNY", "CNY")["value"] == d("0.25")
    assert evidence.coverage_ratio(3, 3, 1) == d("0.75") and evidence.coverage_ratio(0, 0, 0) is None and evidence.coverage_ratio(None, 1) is None
    rules = [{"kind": "required_always", "text": "a"}, {"kind": "required_when", "text": "b", "when": {"state": ("incomplete",)}}, {"kind": "contract_only", "text": "c"}]
    assert evidence.disclosures(rules, {"state": "incomplete"}) == ["a", "b"] and evidence.disclosures(rules, {}) == ["a"]
    assert evidence.reconciled({"x": [d(1), d(2)], "y": [None], "z": [d(1)]}, {"x": d(3), "y": d(1), "z": d(2)}) == ["y", "z"]
    assert evidence.text_report("T", ["k", "v"], [{"k": "a|b", "v": d("1234.5")}, {"k": None, "v": 1}], ["n"]) == "# T\n\n| k | v |\n|---|---|\n| a\\|b | 1,234.5 |\n| – | 1 |\n\n- n\n"
