"""Operators on hand-checked rows, and the queries against their SQL."""

from datetime import date
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quantwell import queries as Q
from quantwell.commerce import OBSERVED, contracts
from quantwell.functions.text import iso_week, unit
from quantwell.operators import aggregates as A
from quantwell.operators import compare as C
from quantwell.operators import entities as R
from quantwell.operators import joins as J
from quantwell.operators import kinds as K
from quantwell.operators import prices as P
from quantwell.plans.errors import QueryError
from quantwell.plans.periods import Period
from quantwell.plans.planner import Planner
from quantwell.plans.request import Request
from quantwell.sources.tables import SnapshotGroup, Store, Tables, freeze_week, limited, observed_rows, paged, probed, probed_sides

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query_against_sql(spark, sql, name):
    got = Q.queries()[name](spark, FOLDER)
    want = sql.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def money(spark, values, schema="k string, v decimal(18,4)"):
    return spark.createDataFrame([(k, None if v is None else Decimal(v)) for k, v in values], schema)


def test_missing_is_not_zero(spark):
    df = money(spark, [("a", 10), ("a", None), ("b", 0), ("c", None)])
    got = {r.k: r for r in A.aggregate(df, ["k"], "sum", [F.col("v")]).collect()}
    assert (got["a"].metric_value, got["a"].missing_value_count, got["a"].known_value_count, got["a"].metric_data_state) == (None, 1, 1, "incomplete")
    assert got["b"].metric_value == 0 and got["b"].metric_data_state == "complete"
    assert got["c"].metric_value is None and got["c"].metric_data_state == "missing" and got["c"].value_coverage_rate == 0
    states = [K.data_state(A.aggregate(df.where(w), [], "sum", [F.col("v")])).first().data_state for w in ("k = 'a'", "k = 'b'", "k = 'c'", "k = 'z'")]
    assert states == ["incomplete", "zero", "undefined", "empty"]


def test_composite_nulls_a_group_with_a_missing_input(spark):
    whole = A.aggregate(money(spark, [("a", 100000), ("a", 50000), ("b", 5)]), ["k"], "sum", [F.col("v")])
    back = A.aggregate(money(spark, [("a", 10000), ("a", 5000), ("b", None)]), ["k"], "sum", [F.col("v")])
    assert {r.k: r.metric_value for r in A.composite([(1, whole), (-1, back)], ["k"]).collect()} == {"a": 135000, "b": None}


def test_differences_skip_rows_with_nulls(spark):
    df = spark.createDataFrame([(5, 3), (1, 4), (None, 2), (7, None)], "a int, b int")
    assert df.agg(A.base_value("sum_positive_difference", [F.col("a"), F.col("b")])).first()[0] == 2


def test_null_keys_meet_when_aligned(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert rows(["k", "a", "b"], J.align(a, b, ["k"]).collect()) == rows(["k", "a", "b"], [(None, 1, 3), ("x", 2, None), ("y", None, 4)])


def test_enriching_neither_drops_nor_multiplies(spark):
    facts = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, k int")
    masters = spark.createDataFrame([(1, "one", "y"), (9, "nine", "n")], "k int, name string, ok string")
    got = J.enrich(facts, masters, {"k": "k"}, {"name": "name"}, F.col("ok") == "y").collect()
    assert rows(["id", "k", "name"], got) == rows(["id", "k", "name"], [(1, 1, "one"), (2, 9, None), (3, None, None)])


def test_contributions_need_exact_partitions(spark):
    schema = "k string, metric_value decimal(18,4), comparison_value decimal(18,4), delta_value decimal(18,4)"
    row = lambda k, a, b: (k, Decimal(a), Decimal(b), Decimal(a - b))
    parts = spark.createDataFrame([row("A", 500000, 200000), row("B", 100000, 200000)], schema)
    overall = spark.createDataFrame([row("", 600000, 400000)], schema)
    assert {r.k: r.net_change_contribution_rate for r in C.decompose(parts, overall).collect()} == {"A": 1.5, "B": -0.5}
    off = spark.createDataFrame([row("", 600001, 400000)], schema)
    assert {(r.reason, r.net_change_contribution_rate) for r in C.decompose(parts, off).collect()} == {("value_mismatch", None)}


@pytest.mark.parametrize("stock,net,days,state", [(100, 50, 61, "available"), (-100, 50, -61, "available"), (100, 0, None, "zero_net"), (100, None, None, "missing_net")])
def test_turnover(spark, stock, net, days, state):
    period = Period(date(2026, 3, 1), date(2026, 5, 1))
    months = [date(2026, m, 1) for m in (2, 3, 4)]
    s = spark.createDataFrame([("a", m, Decimal(stock)) for m in months], "k string, month date, amount decimal(18,4)")
    f = spark.createDataFrame([("a", m, None if net is None else Decimal(net)) for m in months[1:]], "k string, month date, net decimal(18,4)")
    got = K.inventory_turnover(s, f, ["k"], period).first()
    assert (got.turnover_days, got.turnover_state) == (days, state)


def test_turnover_without_a_snapshot(spark):
    period = Period(date(2026, 3, 1), date(2026, 5, 1))
    s = spark.createDataFrame([("a", date(2026, 2, 1), Decimal(1)), ("b", date(2026, 3, 1), Decimal(1)), ("b", date(2026, 4, 1), Decimal(1))], "k string, month date, amount decimal(18,4)")
    f = spark.createDataFrame([("a", date(2026, 3, 1), Decimal(1))], "k string, month date, net decimal(18,4)")
    assert {r.k: r.turnover_state for r in K.inventory_turnover(s, f, ["k"], period).collect()} == {"a": "missing_snapshot", "b": "missing_snapshot"}
    assert {r.turnover_state for r in K.inventory_turnover(s.where("k = 'a'"), f, ["k"], period).collect()} == {"accounting_not_ready"}


def test_net_outbound_may_be_negative(spark):
    flows = lambda q: spark.createDataFrame([("g", date(2026, 1, 5), Decimal(q), Decimal(1), Decimal(2)), ("other", date(2026, 1, 5), Decimal(99), Decimal(1), Decimal(2))], "k string, at date, quantity decimal(18,4), price decimal(18,4), list_price decimal(18,4)")
    got = K.net_outbound(spark.createDataFrame([("g",)], "k string"), flows(5), flows(12), ["k"], date(2026, 1, 1), date(2026, 2, 1)).collect()
    assert [(r.k, r.net_quantity, r.high_price_quantity) for r in got] == [("g", -7, 0)]


def test_ranks_put_unknowns_last(spark):
    got = {r.k: r for r in C.ranked(spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", None)], "k string, v int"), "v").collect()}
    assert [(got[k].rank, got[k].tie_count) for k in "abcd"] == [(3, 1), (1, 2), (1, 2), (4, 1)] and got["a"].unknown_count == 1


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_across_stretches(spark, descending):
    values = [(k, None if k % 17 == 0 else Decimal(k * 7919 % 311)) for k in range(900)]
    got = {r.k: (r.rank, r.tie_count) for r in C.ranked(spark.createDataFrame(values, "k int, v decimal(18,4)"), "v", descending=descending).collect()}
    known = [v for _, v in values if v is not None]
    better = lambda v: sum(w > v if descending else w < v for w in known)
    assert got == {k: (better(v) + 1, known.count(v)) if v is not None else (len(known) + 1, len(values) - len(known)) for k, v in values}
    assert C.ranked(spark.createDataFrame([], "k int, v int"), "v").count() == 0


def test_null_keys_and_no_keys_have_turnovers(spark):
    period = Period(date(2026, 1, 1), date(2026, 3, 1))
    stock = [(k, m, Decimal(100)) for k in ("a", None) for m in (date(2025, 12, 1), date(2026, 1, 1), date(2026, 2, 1))]
    s = spark.createDataFrame(stock, "k string, month date, amount decimal(18,4)")
    f = spark.createDataFrame([(k, m, Decimal(50)) for k in ("a", None) for m in (date(2026, 1, 1), date(2026, 2, 1))], "k string, month date, net decimal(18,4)")
    got = K.inventory_turnover(s, f, ["k"], period).collect()
    assert {(r.k, r.turnover_state, r.net_delivery, r.turnover_days) for r in got} == {("a", "available", 100, 59.0), (None, "available", 100, 59.0)}
    assert [(r.net_delivery, r.turnover_days) for r in K.inventory_turnover(s, f, [], period).collect()] == [(200, 59.0)]
    nothing = K.inventory_turnover(s.limit(0), f.limit(0), [], period).collect()
    assert len(nothing) == 1 and nothing[0].turnover_days is None
    owed, sold = s.withColumnRenamed("amount", "amount"), f.withColumnRenamed("net", "amount")
    assert {(r.k, r.delivery_value, r.dso_days) for r in K.days_sales_outstanding(owed, sold, ["k"], period).collect()} == {("a", 100, 59.0), (None, 100, 59.0)}
    assert [r.delivery_value for r in K.days_sales_outstanding(owed, sold, [], period).collect()] == [200]
    assert K.days_sales_outstanding(owed.limit(0), sold.limit(0), [], period).count() == 1


def test_null_keys_flow_and_have_histories(spark):
    rows = [(None, 1, date(2026, 1, 5), Decimal(5), Decimal(1), Decimal(2)), ("g", 2, date(2026, 1, 5), Decimal(4), Decimal(1), Decimal(2))]
    out = spark.createDataFrame(rows, "k string, order int, at date, quantity decimal(18,4), price decimal(18,4), list_price decimal(18,4)")
    got = K.net_outbound(spark.createDataFrame([("g",), (None,), (None,)], "k string"), out, out.where("k is null"), ["k"], date(2026, 1, 1), date(2026, 2, 1)).collect()
    assert {(r.k, r.net_quantity) for r in got} == {("g", 4), (None, 0)}
    history = K.customer_history(out, out.where("k is null"), ["k"], date(2026, 2, 1)).collect()
    assert {(r.k, r.quantity, r.return_quantity) for r in history} == {("g", 4, 0), (None, 5, 5)}


def test_pools_with_uncertain_identities(spark):
    head = "id int, item string, place string, unit string, quantity decimal(18,4), membership int"
    base = [(1, "x", "d1", "m", 5, 1), (2, "y", "d1", "m", 5, 1), (3, "z", None, "m", 5, 1), (4, "q", "d2", "m", 5, 1), (5, "v", "d1", "m", 4, 1), (6, "w", "d9", "m", 1, 1), (7, "s", "d9", "m", 1, 1)]
    now = [(1, "x", "d1", "m", 3, 1), (2, "y", "d1", "?", 9, 1), (3, "z", "d7", "m", 5, 1), (4, "n", "d2", "m", None, 1), (5, "v", "d1", "m", None, 1), (6, "w", "d9", "m", 1, -1), (7, "s", "d9", "m", 1, 0)]
    decimal = lambda rows: spark.createDataFrame([(*r[:4], None if r[4] is None else Decimal(r[4]), r[5]) for r in rows], head)
    got = {(r.item, r.place, r.uncertainty_key): (r.movement_state, r.delta_quantity) for r in K.pool_comparison(decimal(base), decimal(now), ["item", "place", "unit"], "id", {"unit": ("m", "kg")}).collect()}
    assert got == {
        ("x", "d1", ""): ("Reduced", -2), ("y", "d1", ""): ("Unassessable", None), ("y", "d1", "current:2"): ("Unassessable", None), ("z", None, "base:3"): ("Unassessable", None), ("z", "d7", ""): ("Unassessable", None),
        ("q", "d2", ""): ("Exited", None), ("n", "d2", ""): ("New", None), ("v", "d1", ""): ("Unassessable", None), ("w", "d9", ""): ("Unassessable", None), ("s", "d9", ""): ("Exited", None),
    }


def test_existence_under_unknown_keys(spark):
    whole = [(a, b) for a in "xyz" for b in (1, 2, 3)]
    lost = [("x", None), (None, 3)]
    got = J.exists_or_unknown(spark.createDataFrame(whole, "a string, b int"), spark.createDataFrame(lost, "a string, b int"), ["a", "b"], "hit").collect()
    assert {(r.a, r.b) for r in got if r.hit} == {(a, b) for a, b in whole if a == "x" or b == 3} and len(got) == 9


def test_snapshot_groups_read_one_state(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    group = SnapshotGroup(Tables(spark, folder))
    group.pin("t")
    spark.range(5).write.mode("append").parquet(f"{folder}/t.parquet")
    assert group.run(lambda t: t.raw("t")).count() == 3 and Tables(spark, folder).raw("t").count() == 8
    with pytest.raises(ZeroDivisionError):
        group.run(lambda t: 1 // 0)
    with pytest.raises(QueryError) as e:
        group.run(lambda t: t.raw("t"))
    assert e.value.code == "SNAPSHOT_GROUP_POISONED"


def test_stores_keep_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", {"log": "k int, v string"})
    assert store.rows("log").count() == 0
    store.insert("log", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"))
    store.update("log", F.col("v") == "a", {"v": F.lit("z")})
    assert store.delete("log", F.col("k") == 2) == 3
    assert {tuple(r) for r in store.rows("log").collect()} == {(1, "z"), (3, None)}
    for f in (lambda: store.write("log", store.rows("log"), expected=2), lambda: store.rows("other")):
        with pytest.raises(QueryError):
            f()
    with pytest.raises(QueryError):
        observed_rows(spark.range(5), 4)
    assert [r.id for r in observed_rows(spark.range(5), 5).collect()] == [0, 1, 2, 3, 4]


def test_price_classes_and_changes(spark):
    schema = "product int, region string, price decimal(18,2), quote_id string, valid_from date, valid_to date"
    on = date(2026, 1, 10)
    values = [
        (1, "r", Decimal(5), "a", date(2026, 1, 1), date(2026, 2, 1)), (2, "r", None, None, None, None), (3, "r", Decimal(5), "a", None, None), (3, "r", Decimal(6), "b", None, None), (4, "r", Decimal(-1), "a", None, None),
        (5, "r", Decimal(5), "a", date(2026, 1, 11), None), (6, "r", Decimal(5), "a", None, date(2026, 1, 9)), (7, "r", Decimal(5), "a", None, on), (8, "r", Decimal(5), "a", None, None), (9, "r", Decimal(5), "a", date(2026, 3, 1), date(2026, 2, 1)), (10, "r", None, "a", None, None),
    ]
    got = P.classify(spark.createDataFrame(values, schema), on)
    assert [r.price_class for r in got.orderBy("product").collect()] == ["comparable", "missing_identity_or_quote", "ambiguous_latest", "negative_price", "not_yet_effective", "expired", "validity_boundary", "unknown_validity", "invalid_validity", "missing_price"]
    head = "product int, region string, price int, price_class string"
    a = spark.createDataFrame([(1, "r", 5, "comparable"), (2, "r", 5, "comparable"), (3, "r", None, "expired"), (4, "r", 5, "comparable"), (5, "r", None, "expired"), (6, "r", None, "expired")], head)
    b = spark.createDataFrame([(1, "r", 6, "comparable"), (2, "r", 4, "comparable"), (3, "r", 5, "comparable"), (4, "r", None, "expired"), (5, "r", None, "missing_price"), (7, "r", 1, "comparable")], head)
    assert [r.event for r in P.changes(a, b).orderBy("product").collect()] == ["increased", "decreased", "became_comparable", "no_longer_comparable", "reason_changed", "removed", "added"]


def test_freezes_replace_one_week(spark, tmp_path):
    path = f"file://{tmp_path}/baseline"
    week = lambda v: spark.createDataFrame([(1, v), (2, v)], "id int, quantity int")
    freeze_week(week(5), path, "2026-W01")
    freeze_week(week(6), path, "2026-W02")
    assert freeze_week(week(7), path, "2026-W01").count() == 2
    assert {(r.week_label, r.quantity) for r in spark.read.parquet(path).collect()} == {("2026-W01", 7), ("2026-W02", 6)}
    plan, issues = P.freeze_plan(spark.createDataFrame([(1, 1, "m", 20), (1, 2, None, 30), (2, 3, "m", 5)], "id int, item int, unit string, quantity int"), spark.createDataFrame([(9,)], "item int"), 10)
    assert plan.count() == 2 and tuple(issues.first()) == (0, 1, 1, 2, True)


def test_pages_and_limits(spark):
    df = spark.range(25)
    seen, after = [], None
    while page := [r.id for r in paged(df, "id", after, 10).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == list(range(25))
    assert {r.truncated for r in limited(df, 24, [F.asc("id")]).collect()} == {True} and {r.truncated for r in limited(df, 25, [F.asc("id")]).collect()} == {False}


def test_pair_probes_form_no_pairs(spark):
    keys = [None, 0, 1, 2, 3, 11, 12]
    facts = spark.createDataFrame([(a, b) for a in keys for b in keys] * 2, "a long, b long")
    left, right = (spark.createDataFrame([(k,) for k in ks], f"{name} long") for name, ks in (("x", (None, 1, 1, 2, 3, 12)), ("y", (None, 0, 2, 2, 11, 12))))
    got = probed_sides(facts, {"a": (left, "x"), "b": (right, "y")}, F.col("a") % 10 == F.col("b") % 10)
    pairs = left.join(right, F.col("x") % 10 == F.col("y") % 10).select(F.col("x").alias("a"), F.col("y").alias("b"))
    expected = sorted([(1, 11), (2, 2), (2, 12), (12, 2), (12, 12)] * 2)
    assert sorted(map(tuple, got.collect())) == expected == sorted(map(tuple, probed(facts, pairs, ["a", "b"]).collect()))
    df = Q.queries()["s8_pair_probe"](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2 and "Join Inner" not in plan


def test_the_observed_read_is_whole(spark, tmp_path):
    n = F.col("id")
    texts = [F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")]
    spark.range(1_000_001).select(n.alias("p_partkey"), *texts, (n % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = Q.queries()["s7_budgeted_read"](spark, str(tmp_path)).agg(F.count("*"), F.count_distinct("p_partkey"), F.min("p_partkey"), F.max("p_partkey")).first()
    assert tuple(got) == (1_000_001, 1_000_001, 0, 1_000_000)


def test_scans_show_whitelisted_columns_only(spark):
    t = Tables(spark, FOLDER)
    for columns in (["l_comment"], ["l_tax"]):
        with pytest.raises(QueryError) as e:
            t.scan(contracts().datasets["delivery"], columns)
        assert e.value.code == "COLUMN_NOT_ALLOWED"


def test_filters_and_columns_reach_the_scan(spark):
    planner = Planner(contracts(), Tables(spark, FOLDER), OBSERVED)
    df = planner.plan(Request("gross_amount", ("region",), {"status": "F"}, Period(date(2000, 3, 1), date(2000, 4, 1))))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = df._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(x for x in text.splitlines() if "FileScan" in x and "l_shipdate" in x)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "EqualTo(l_linestatus,F)" in scan and "l_partkey" not in scan.split("ReadSchema")[1]


def test_units_and_weeks(spark):
    got = spark.createDataFrame([(" M ", date(2021, 1, 3)), ("kg", date(2020, 12, 31)), ("  ", None), (None, date(2024, 1, 1))], "u string, d date").select(unit(F.col("u")), iso_week(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("m", "2020-W53"), ("kg", "2020-W53"), (None, None), (None, "2024-W01")]


def test_entities(spark):
    master = spark.createDataFrame([(1, "Acme  Trading"), (2, "acme trading east"), (3, "The Acme Trading"), (4, "Twin"), (5, "twin")], "id int, name string")
    got = R.candidates(" ACME trading", {"customer": (master, "id", "name")}).collect()
    assert [(r.identity, r.match_rank) for r in got] == [("1", 0), ("2", 1), ("3", 2)] and len({r.reference for r in got}) == 3
    aliases = {"north": ("7", "8")}
    assert R.canonical(["North", "acme trading"], aliases, master, "id", "name") == {"North": ("7", "8"), "acme trading": ("1",)}
    for name, error in (("TWIN", "ENTITY_AMBIGUOUS"), ("nobody", "ENTITY_NOT_FOUND")):
        with pytest.raises(QueryError) as e:
            R.canonical([name], aliases, master, "id", "name")
        assert e.value.code == error
    with pytest.raises(QueryError):
        R.candidates("ab", {})
    names = spark.createDataFrame([(1, "Straße 7"), (2, "ＡＢＣ　Ltd"), (3, "İzmir"), (4, None)], "id int, name string")
    for token, identity in (("STRASSE 7", "1"), ("Straße 7", "1"), ("abc ltd", "2"), ("ＡＢＣ Ltd", "2"), ("İZMIR", "3")):
        assert [(r.identity, r.match_rank) for r in R.candidates(token, {"place": (names, "id", "name")}).collect()] == [(identity, 0)]
        assert R.canonical([token], {}, names, "id", "name") == {token: (identity,)}


def test_the_rest_works_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quantwell", tmp_path / "quantwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = "import __spark_entry__ as e; assert len(e.queries()) > 70 and set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
