"""Every ledger query against its SQL in DuckDB, and streams against batches."""

import duckdb
import pytest

from tidemark.functions import predicates as P
from tidemark.plans import registry
from tidemark.streaming import jobs


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in ("events", "nation", "customer"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/sf0.001/{name}.parquet'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str([f"{x:.9g}" if isinstance(x, float) else str(x) for x in row]) for row in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    got = registry.QUERIES[name](spark, f"{data}/sf0.001").toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_filters_reach_the_scan(spark, data):
    rows = registry.L.ledger(spark, f"{data}/sf0.001").filter(P.EVENTS_BASELINE.holds()).select("amount_paid")
    plan = rows._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_stream_goes_on_from_its_checkpoint(spark, data, tmp_path):
    source = tmp_path / "in"
    rows = spark.read.parquet(f"{data}/sf0.001/events.parquet")
    rows.filter("event_id < 500").coalesce(1).write.parquet(str(source / "events.parquet"))

    def run():
        stream = jobs.ledger_stream(spark, str(source)).filter(P.in_dollars()).select("tx_id")
        return jobs.appended(stream, str(tmp_path / "out"), str(tmp_path / "offsets"))

    first = run().count()
    rows.filter("event_id >= 500").coalesce(1).write.mode("append").parquet(str(source / "events.parquet"))
    both = run()
    assert first < both.count() == both.distinct().count() == registry.L.ledger(spark, f"{data}/sf0.001").filter(P.in_dollars()).count()
    assert run().count() == both.count()


def test_a_complete_aggregate_is_read_again(spark, data, tmp_path):
    def run():
        return jobs.completed(registry.A.largest_payment_in_one_pass(jobs.ledger_stream(spark, f"{data}/sf0.001")), str(tmp_path / "out"), str(tmp_path / "offsets"))

    first = sorted(map(tuple, run().collect()))
    assert first and sorted(map(tuple, run().collect())) == first
