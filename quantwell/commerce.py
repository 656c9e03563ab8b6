"""Contracts over the supplied star schema: deliveries, orders and their masters."""

from __future__ import annotations

from datetime import date

from quantwell.plans.contracts import Contracts, Dataset, Dimension, Filter, Join, Metric, MetricJoin, ValueContract

OBSERVED = date(2000, 6, 15)

_MONEY = "cast({} as decimal(18,4))"

DATASETS = (
    Dataset(
        "delivery", "lineitem",
        ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "amount", "quantity", "price", "rate", "list_amount", "partial_amount"),
        joins=(Join("orders", ("l_orderkey",), ("o_orderkey",)), Join("part", ("l_partkey",), ("p_partkey",)), Join("supplier", ("l_suppkey",), ("s_suppkey",))),
        derived={
            "amount": _MONEY.format("l_extendedprice * (1 - l_discount)"), "quantity": _MONEY.format("l_quantity"), "price": _MONEY.format("l_extendedprice"), "rate": _MONEY.format("l_tax"),
            "list_amount": _MONEY.format("l_quantity * 1500"), "partial_amount": "case when l_linenumber = 7 and l_partkey % 3 = 0 then null else cast(l_extendedprice as decimal(18,4)) end",
        },
        blocked=("l_comment",),
    ),
    Dataset(
        "orders", "orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "total", "known_total"), unique_keys=(("o_orderkey",),),
        joins=(Join("customer", ("o_custkey",), ("c_custkey",)),), derived={"total": _MONEY.format("o_totalprice"), "known_total": "case when o_orderdate < timestamp '2000-05-01' then cast(o_totalprice as decimal(18,4)) end"},
    ),
    Dataset("settled", "lineitem", ("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", "amount"), required=(Filter("l_returnflag", "in", ("A", "R")),), derived={"amount": _MONEY.format("l_extendedprice * (1 - l_discount)")}),
    Dataset("large_part", "part", ("p_partkey", "p_size"), "master_snapshot", (("p_partkey",),), required=(Filter("p_size", "gt", 25),)),
    Dataset("customer", "customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "master_snapshot", (("c_custkey",),), joins=(Join("nation", ("c_nationkey",), ("n_nationkey",)),)),
    Dataset("supplier", "supplier", ("s_suppkey", "s_name", "s_nationkey"), "master_snapshot", (("s_suppkey",),), joins=(Join("nation", ("s_nationkey",), ("n_nationkey",)),)),
    Dataset("part", "part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "master_snapshot", (("p_partkey",),)),
    Dataset("nation", "nation", ("n_nationkey", "n_name", "n_regionkey"), "master_snapshot", (("n_nationkey",),), joins=(Join("region", ("n_regionkey",), ("r_regionkey",)),)),
    Dataset("region", "region", ("r_regionkey", "r_name"), "master_snapshot", (("r_regionkey",),)),
)

DIMENSIONS = (
    Dimension("region", {"region": "r_name"}, "r_name", "region", ("orders", "customer", "nation")),
    Dimension("nation", {"nation": "n_name"}, "n_name", "nation", ("orders", "customer")),
    Dimension("segment", {"segment": "c_mktsegment"}, "c_mktsegment", "customer", ("orders",)),
    Dimension("supplier_nation", {"supplier_nation": "n_name"}, "n_name", "nation", ("supplier",)),
    Dimension("brand", {"brand": "p_brand"}, "p_brand", "part"),
    Dimension("status", {"status": "l_linestatus"}, "l_linestatus", values=ValueContract(("F", "O"), {"final": "F", "open": "O"})),
    Dimension("return_flag", {"return_flag": "l_returnflag"}, "l_returnflag", meter=True),
    Dimension("order_status", {"order_status": "o_orderstatus"}, "o_orderstatus"),
    Dimension("unit", {"unit": "p_brand"}, "p_brand", "part"),
)

METRICS = (
    Metric("gross_amount", "delivery", "sum", ("amount",), time="l_shipdate", filters=(Filter("l_linestatus", "eq", "F"),), default_period="current_month"),
    Metric("return_amount", "delivery", "sum", ("amount",), time="l_shipdate", filters=(Filter("l_returnflag", "eq", "R"),), default_period="current_month"),
    Metric("partial_amount", "delivery", "sum", ("partial_amount",), time="l_shipdate", default_period="last_12_completed_months"),
    Metric("taxed_amount", "delivery", "sum_product", ("price", "rate"), time="l_shipdate", default_period="last_3_completed_months"),
    Metric("order_count", "delivery", "count_distinct", ("l_orderkey",), time="l_shipdate", default_period="last_3_completed_months"),
    Metric("delivered_quantity", "delivery", "sum", ("quantity",), time="l_shipdate", scope="unit", default_period="last_3_completed_months"),
    Metric("net_amount", components=((1, "gross_amount"), (-1, "return_amount")), default_period="current_month"),
    Metric("return_rate", numerator="return_amount", denominator="gross_amount", default_period="current_month"),
    Metric("latest_orders", "orders", "sum", ("total",), time="o_orderdate", default_period="latest_snapshot"),
    Metric("latest_known_orders", "orders", "sum", ("known_total",), time="o_orderdate", default_period="latest_non_null_snapshot", required_measure="known_total"),
    Metric("returned_settled", "settled", "sum", ("amount",), time="l_shipdate", filters=(Filter("l_returnflag", "eq", "R"),), default_period="current_month"),
    Metric("stock_quantity", "delivery", "sum", ("quantity",), default_period="current_snapshot", scopes={"total": (), "returned": (Filter("l_returnflag", "eq", "R"),), "open": (Filter("l_linestatus", "eq", "O"),)}),
    Metric("building_orders", "orders", "sum", ("total",), default_period="current_snapshot", joins=(MetricJoin("customer", ("o_custkey",), ("c_custkey",), (Filter("c_mktsegment", "eq", "BUILDING"),), ("c_nationkey",)),)),
    Metric("small_part_amount", "delivery", "sum", ("amount",), default_period="current_snapshot", joins=(MetricJoin("large_part", ("l_partkey",), ("p_partkey",), required_missing=True),)),
    Metric("ledger_amount", "delivery", "sum", ("amount",), time="l_shipdate", default_period="current_month", attribution_modes=("shared",)),
    Metric("planned_amount", "delivery", "sum", ("amount",), time="l_shipdate", available=False),
)


def contracts() -> Contracts:
    named = lambda xs: {x.name: x for x in xs}
    return Contracts(named(DATASETS), named(DIMENSIONS), named(METRICS))
