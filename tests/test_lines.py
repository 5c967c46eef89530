"""Ledgers from streams of lines."""

import datetime as dt
import socket
import threading

import pytest

from tidemark.plans import usecases as U
from tidemark.streaming import lines

GOOD = "2022/09/01 00:20,011,8000EBD30,070,8000EBD31,10.5,US Dollar,10.5,US Dollar,Wire,0"


def test_lines_become_a_ledger(spark):
    df = spark.createDataFrame([(GOOD,), (GOOD.replace("10.5", "99.0"),)], "value string")
    got = lines.transactions(df).orderBy("amount_paid").collect()
    assert [(r.from_bank, r.to_bank, r.amount_paid, r.ts) for r in got] == [(11, 70, 10.5, dt.datetime(2022, 9, 1, 0, 20)), (11, 70, 99.0, dt.datetime(2022, 9, 1, 0, 20))]
    bad = spark.createDataFrame([(GOOD,), ("x",), (GOOD.replace("011", "one"),), ("",)], "value string")
    assert lines.transactions(bad, lenient=True).count() == 1
    with pytest.raises(Exception, match="not a transaction"):
        lines.transactions(bad).collect()


def test_a_socket_feeds_a_question(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def send():
        connection, _ = server.accept()
        connection.sendall("".join(f"{GOOD.replace('10.5', str(a))}\n" for a in (10.5, 60.0, 49.99)).encode())
        done.wait(60)
        connection.close()

    done = threading.Event()
    thread = threading.Thread(target=send, daemon=True)
    thread.start()
    rows = U.low_value(lines.transactions(lines.socket_lines(spark, "127.0.0.1", server.getsockname()[1])))
    query = rows.writeStream.format("memory").queryName("from_socket").start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table("from_socket").count() == 2:
                break
            done.wait(0.5)
        assert sorted(r.amount_paid for r in spark.table("from_socket").collect()) == [10.5, 49.99]
    finally:
        query.stop()
        done.set()
        server.close()


def test_a_queue_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        lines.queue_lines(spark, "localhost:9092", "payments", 100)
