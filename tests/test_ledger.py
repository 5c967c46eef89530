"""Micro-fixtures with known answers for the five questions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators import aggregates as A, graph as G, sampling
from tidemark.plans import usecases as U
from tidemark.sources import ledgers as L, rates as R, sinks

COLUMNS = "ts string, from_bank long, from_account string, to_bank long, to_account string, amount_paid double, payment_currency string, payment_format string"
USD = "US Dollar"


def ledger(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("ts", L.parse_ts(F.col("ts")))


def tx(ts="2022/09/01 00:00", a=(1, "A"), b=(2, "B"), amount=1.0, currency=USD, kind="Cash"):
    return (ts, a[0], a[1], b[0], b[1], amount, currency, kind)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_low_value_is_strict_and_a_bag(spark):
    df = ledger(spark, [tx(amount=49.99), tx(amount=50.0), tx(amount=10.0, currency="Euro"), tx(amount=49.99)])
    assert [r[4] for r in rows(U.low_value(df))] == [49.99, 49.99]


def test_bank_max_ties_and_unnamed_banks(spark):
    df = ledger(spark, [tx(a=(1, "A"), amount=900.0), tx(a=(1, "Z"), amount=900.0), tx(a=(7, "Q"), amount=5000.0), tx(a=(2, "B"), amount=9999.0, currency="Euro"), tx(a=(2, "C"), amount=70.0)])
    accounts = spark.createDataFrame([("Two", 2), ("One", 1), ("Uno", 1), ("Nine", 9)], "bank_name string, bank_id long")
    assert rows(U.bank_max(df, accounts)) == [(1, "Z", "One", 900.0), (2, "C", "Two", 70.0)]
    assert rows(A.largest_payment_by_rank(df)) == rows(A.largest_payment_in_one_pass(df))
    usd = df.filter(P.in_dollars())
    assert rows(A.largest_payment_by_rank(usd)) == rows(A.largest_payment(usd)) == rows(A.largest_payment_in_one_pass(usd))


def test_far_below_average_periods(spark):
    df = ledger(spark, [
        tx(amount=1000.0), tx("2022/09/05 23:59", amount=3000.0), tx("2022/09/06 00:00", amount=19.99), tx("2022/09/15 23:59", amount=1.0),
        tx("2022/09/16 00:00", amount=1.0), tx("2022/09/10 00:00", amount=20.0), tx("2022/09/10 00:00", amount=0.01, kind="Credit Card"),
    ])
    for exact in (False, True):
        assert [r[3] for r in rows(U.far_below_average(df, exact=exact))] == [1.0, 19.99]


def test_format_averages(spark):
    df = ledger(spark, [tx(amount=60.0, kind="ACH"), tx(amount=40.0, kind="ACH"), tx(amount=-10.0, kind="ACH"), tx(amount=20.0, kind="Wire")])
    assert rows(A.format_averages(df)) == [("ACH", 30.0), ("Wire", 20.0)]
    assert rows(A.exact_format_averages(df)) == [("ACH", 30.0), ("Wire", 20.0)]


def scatter():
    s, t, v = (8, "S"), (9, "T"), (9, "V")
    mid = [(b, f"b{b}") for b in range(1, 6)]
    day = "2022/09/02 10:00"
    out = [tx(day, s, b) for b in mid] + [tx(day, b, t) for b in mid] + [tx(day, b, v) for b in mid[:4]] + [tx(day, mid[3], v)] + [tx(day, b, s) for b in mid]
    return out + [tx("2022/09/06 00:00", mid[4], v)]


def test_scatter_gather(spark):
    df = ledger(spark, scatter())
    assert rows(U.scatter_gather(df)) == [(8, "S"), (9, "T")]
    edges = U.scatter_gather_edges(df)
    pairs = rows(G.pair_counts(edges, 5))
    assert pairs == [(8, "S", 9, "T", 5)]
    assert pairs == rows(G.pair_counts(edges, 5, prune=False)) == rows(G.pair_counts(edges, 5, salt=4))
    assert rows(U.scatter_gather(df.union(df).repartition(7))) == [(8, "S"), (9, "T")]


def test_nodes_compare_both_fields(spark):
    ends = [(1, "18X"), (11, "8X")]
    mid = [(5, f"m{k}") for k in range(5)]
    df = ledger(spark, [tx(a=ends[k % 2], b=m) for k, m in enumerate(mid)] + [tx(a=m, b=(3, "Z")) for m in mid])
    assert rows(U.scatter_gather(df)) == []


def test_self_loops_count_as_intermediaries(spark):
    a, c = (1, "a"), (2, "c")
    mid = [a, c, (3, "x"), (3, "y"), (3, "z")]
    df = ledger(spark, [tx(a=a, b=m) for m in mid] + [tx(a=m, b=c) for m in mid])
    assert (1, "a", 2, "c", 5) in rows(G.pair_counts(U.scatter_gather_edges(df), 5))


def test_small_transfers(spark):
    df = ledger(spark, [
        tx(amount=0.99, kind="Wire"), tx(amount=0.90, currency="Euro", kind="ACH"), tx(amount=0.95, currency="Euro", kind="ACH"),
        tx(amount=0.5, currency="Doubloon", kind="ACH"), tx("2022/09/06 00:00", amount=0.1, kind="Wire"), tx(amount=0.1),
    ])
    rates = R.fixed(spark, {USD: 1.0, "Euro": 1.09})
    assert rows(U.small_transfers(df, rates)) == [(3,)]
    assert rows(U.small_transfers(df.limit(0), rates)) == [(0,)]


def test_daily_rates_come_first(spark):
    day = dt.date(2022, 9, 1)
    rates = R.daily(spark, {day: {"Euro": 2.0, "Bitcoin": 1.0}}, {(day, "Bitcoin"): 20.0}).union(R.fixed(spark, {"Euro": 3.0}))
    df = ledger(spark, [tx(currency="Euro"), tx("2022/09/02 00:00", currency="Euro"), tx(currency="Bitcoin"), tx(currency="?")])
    out = R.converted(df, rates)
    assert sorted(r.amount_paid for r in out.collect()) == [1.0, 2.0, 3.0, 20.0]
    assert {r.payment_currency for r in out.collect()} == {USD}


def test_rates_from_euro():
    out = R.from_euro({"USD": 1.1, "GBP": 0.88}, {"GBP": "Pound", "EUR": "Euro", "USD": USD}, {"Ruble": 0.01})
    assert out == {"Pound": pytest.approx(1.25), "Euro": 1.1, USD: 1.0, "Ruble": 0.01}


def test_backoff_doubles_up_to_its_cap():
    slept, left = [], [5]

    def fetch(day):
        if left[0]:
            left[0] -= 1
            raise OSError
        return {USD: 1.0}

    assert R.fetched([dt.date(2022, 9, 1)] * 2, fetch, base=1, cap=4, sleep=slept.append) == {dt.date(2022, 9, 1): {USD: 1.0}}
    assert slept == [1, 2, 4, 4, 4]
    with pytest.raises(OSError):
        R.fetched([dt.date(2022, 9, 1)], lambda d: (_ for _ in ()).throw(OSError()), attempts=2, sleep=slept.append)


def test_csv_is_positional(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    (tmp_path / "t.csv").write_text(head + "2022/09/01 00:20,011,8000EBD30,070,8000EBD31,10.5,US Dollar,10.5,US Dollar,Wire,0\n")
    got = L.read_transactions(spark, str(tmp_path / "t.csv")).collect()
    assert got[0].from_bank == 11 and got[0].to_bank == 70 and got[0].to_account == "8000EBD31" and got[0].ts == dt.datetime(2022, 9, 1, 0, 20)
    (tmp_path / "bad.csv").write_text(head + "2022/09/01 00:20,x,A,1,B,1,US Dollar,1,US Dollar,Wire,0\n")
    with pytest.raises(Exception):
        L.read_transactions(spark, str(tmp_path / "bad.csv")).collect()
    assert L.read_transactions(spark, str(tmp_path / "bad.csv"), lenient=True).count() == 0


def test_timestamps(spark):
    df = spark.createDataFrame([("2022/09/01 00:20",), ("2022-09-01 00:20:30",), (None,)], "t string")
    assert [r[0] for r in df.select(L.parse_ts(F.col("t"))).collect()] == [dt.datetime(2022, 9, 1, 0, 20), dt.datetime(2022, 9, 1, 0, 20, 30), None]
    with pytest.raises(Exception):
        spark.createDataFrame([("yesterday",)], "t string").select(L.parse_ts(F.col("t"))).collect()


def test_float_text_is_as_in_reports(spark):
    values = [0.0, 1.0, 10000000.0, 123456789.25, 0.0001, 0.00025, 1e-5, -3.5, 49.99, 1e15, -0.0002]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(sinks.float_text("v")).collect()]
    assert [g for v, g in zip(values, got) if v != 1e-5] == [repr(v) for v in values if v != 1e-5]


def test_padding_never_cuts(spark):
    from tidemark.plans import reports

    df = spark.createDataFrame([("a bank with a very long number", "ab")], "bank string, account string")
    assert reports.scatter_gather(df).first().line == "bank: a bank with a very long number account: ab"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (1, "z")], "client_id int, v string")
    sinks.write_by_client(df, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir()) == ["client_id=1", "client_id=2"]
    sinks.write_csv(df.limit(0), str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e"), header=True).count() == 0
    sinks.write_report({"UC1": df.select("v"), "UC5": df.limit(0).select("v")}, str(tmp_path / "r"))
    lines = [line for p in sorted((tmp_path / "r").glob("part*")) for line in p.read_text().splitlines()]
    assert lines[0] == "--- UC1 ---" and sorted(lines[1:4]) == ["x", "y", "z"] and lines[4:] == ["--- UC5 ---"]


def test_clients_are_apart(spark):
    both = ledger(spark, scatter()).withColumn("client_id", F.lit(1)).union(ledger(spark, scatter()[:8]).withColumn("client_id", F.lit(2)))
    assert rows(U.scatter_gather(both, by=("client_id",))) == [(1, 8, "S"), (1, 9, "T")]


def test_sample_is_exact_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = rows(sampling.exactly(df, 10, "k"))
    assert len(one) == 10 and one == rows(sampling.exactly(df.repartition(5), 10, "k"))


def test_routes(spark):
    df = ledger(spark, [tx(amount=1.0), tx(amount=99.0)])
    out = P.routed(df, {"all": P.anything(), "low": P.below(50)})
    assert sorted((r.route, r.amount_paid) for r in out.collect()) == [("all", 1.0), ("all", 99.0), ("low", 1.0)]


def test_set_operators(spark):
    df = ledger(spark, [tx(a=(1, "A"), b=(2, "A")), tx(a=(3, "B"), b=(3, "B"))])
    assert rows(A.accounts_of_several_banks(df)) == [("A", 2)]
    graph = G.edges(df)
    assert rows(G.neighbours(graph)) == [(1, "A", 0, 1), (2, "A", 1, 0), (3, "B", 1, 1)]
    assert rows(G.both_ends(graph, 1)) == [(3, "B")]


def test_small_sides_are_broadcast_whatever_the_threshold(spark, tmp_path):
    """Neither the averages nor the rates move the ledger, though Spark would estimate both as large."""
    big = ledger(spark, [tx(amount=float(k)) for k in range(50)]).crossJoin(spark.range(400).select(F.col("id").alias("copy")))
    big.write.parquet(str(tmp_path / "ledger"))
    df = spark.read.parquet(str(tmp_path / "ledger"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20")
    try:
        for made in (U.far_below_average(df), U.converted(df, R.fixed(spark)), U.converted(df, R.daily(spark, {dt.date(2022, 9, 1): {"Euro": 2.0}}).union(R.fixed(spark)))):
            plan = made._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            joined = made._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(payment_format" not in joined and "hashpartitioning(payment_currency" not in joined
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rates_of_unknown_size_are_not_broadcast(spark):
    many = R.fixed(spark).rdd.toDF(R.RATES)
    assert "broadcast" not in R.storage.small(many)._jdf.queryExecution().analyzed().toString()
    df = ledger(spark, [tx(currency="Euro", kind="ACH", amount=0.9)])
    assert [r.amount_paid for r in R.converted(df, many).collect()] == [pytest.approx(0.981)]


def test_hubs_are_dealt_out(spark):
    """A hub of 40 x 40 paths beside ordinary nodes, in parts of 100 paths."""
    hub, day = (5, "hub"), "2022/09/02 10:00"
    out = [tx(day, (1, f"a{k}"), hub) for k in range(40)] + [tx(day, hub, (2, f"c{k}")) for k in range(40)]
    edges = U.scatter_gather_edges(ledger(spark, out + scatter()))
    want = rows(G.pair_counts(edges, 1, prune=False, salt=1))
    assert rows(G.pair_counts(edges, 1, prune=False, paths=100)) == want == rows(G.pair_counts(edges, 1, prune=False, paths=10**9)) and len(want) > 1600
    left = edges.select(F.col("dst_bank").alias("b_bank"), F.col("dst_account").alias("b_account"))
    right = edges.select(F.col("src_bank").alias("b_bank"), F.col("src_account").alias("b_account"))
    assert rows(G.hubs(left, right, ["b_bank", "b_account"], 100)) == [(5, "hub", 16)]


def test_null_amounts_are_never_largest(spark):
    df = ledger(spark, [tx(a=(1, "A"), amount=None), tx(a=(1, "B"), amount=2.0), tx(a=(3, "C"), amount=None)])
    for f in (A.largest_payment, A.largest_payment_in_one_pass, A.largest_payment_by_rank):
        assert rows(f(df)) == [(1, "B", 2.0)]


def test_numbers_have_no_gaps(spark, tmp_path):
    df = spark.range(1000).repartition(7).filter("id % 3 > 0")
    got = sinks.numbered(df)
    assert sorted(r["index"] for r in got.collect()) == list(range(df.count())) and got.columns == ["index", "id"]
    assert sinks.numbered(df.limit(0)).count() == 0


def test_report_lines(spark):
    from tidemark.plans import reports

    df = ledger(spark, [tx(a=(11, "A"), amount=10.5)])
    assert reports.low_value(df).first().line == f"origin: {'11-A':<20} destination: {'2-B':<20} amount: 10.5"
    assert reports.far_below_average(df).first().line == f"bank_id: {11:<20} account: {'A':<20} payment_format: {'Cash':<20} amount: 10.5"
    assert reports.scatter_gather(df.select(F.col("from_bank").alias("bank"), F.col("from_account").alias("account"))).first().line == f"bank: {11:<20} account: A"
    assert reports.small_transfers(spark.range(3, 4).toDF("n_transfers")).first().line == "count: 3"


def test_client_reports_are_ordered_files(spark, tmp_path):
    lines = spark.createDataFrame([(1, "b"), (2, "x"), (1, "a")], "client_id int, line string")
    sinks.write_client_reports({"UC1": lines, "UC5": lines.filter("line = 'x'")}, lines.select("client_id").distinct(), str(tmp_path / "r"), ordered=True)
    read = lambda c: [x for p in sorted((tmp_path / "r" / f"client_id={c}").glob("part*")) for x in p.read_text().splitlines()]
    assert read(1) == ["--- UC1 ---", "a", "b", "--- UC5 ---"] and read(2) == ["--- UC1 ---", "x", "--- UC5 ---", "x"]


def test_rates_of_a_service(spark):
    day = dt.date(2022, 9, 1)
    got = {r.currency: r.usd_rate for r in R.of_service(spark, {day: {"USD": 1.0, "GBP": 0.8}}).collect()}
    assert got == {"US Dollar": 1.0, "Euro": 1.0, "UK Pound": pytest.approx(1.25), "Bitcoin": 20131.46, "Ruble": 0.01, "Saudi Riyal": 0.27}
    assert {r.currency: r.usd_rate for r in R.of_service(spark, {dt.date(2023, 1, 1): {"USD": 1.0}}).collect()}["Bitcoin"] == 78.33
