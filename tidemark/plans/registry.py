"""Query keys of the ledger engine and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import storage
from tidemark.functions import predicates as P
from tidemark.operators import aggregates as A, graph as G, sampling
from tidemark.plans import reports, usecases as U
from tidemark.sources import ledgers as L, rates as R, sinks
from tidemark.streaming import jobs

S = U.EVENTS
K = S.intermediaries

LEDGER_SQL = """ledger AS (
  SELECT event_id AS tx_id, ts, user_id % 25 AS from_bank, CAST(user_id AS VARCHAR) AS from_account,
    CAST(k AS BIGINT) % 25 AS to_bank, k AS to_account, value AS amount_paid,
    CASE WHEN event_id % 10 < 8 THEN 'US Dollar' WHEN event_id % 10 = 8 THEN 'Euro' ELSE 'Bitcoin' END AS payment_currency,
    CASE event_type WHEN 'click' THEN 'Wire' WHEN 'error' THEN 'ACH' WHEN 'purchase' THEN 'Cheque' WHEN 'signup' THEN 'Credit Card' WHEN 'view' THEN 'Reinvestment' END AS payment_format
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events)),
names AS (SELECT CAST(n_nationkey AS BIGINT) AS bank_id, min(n_name) AS bank_name FROM nation GROUP BY n_nationkey),
usd AS (SELECT * FROM ledger WHERE payment_currency = 'US Dollar'),
a AS (SELECT * FROM usd WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-06'),
b AS (SELECT * FROM usd WHERE ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-16'),
top AS (SELECT from_bank, from_account, amount_paid FROM (SELECT *, row_number() OVER (PARTITION BY from_bank ORDER BY amount_paid DESC, from_account DESC) AS r FROM usd) WHERE r = 1),
sums AS (SELECT payment_format, CAST(sum(CAST(amount_paid AS DECIMAL(18,2))) AS DOUBLE) AS amount_sum, count(*) AS n FROM a GROUP BY 1),
average AS (SELECT payment_format, amount_sum / n AS amount_avg FROM sums),
edges AS (SELECT DISTINCT from_bank AS src_bank, from_account AS src_account, to_bank AS dst_bank, to_account AS dst_account FROM a),
hi_out AS (SELECT src_bank, src_account, count(*) AS degree FROM edges GROUP BY 1, 2 HAVING count(*) >= 5),
hi_in AS (SELECT dst_bank, dst_account, count(*) AS degree FROM edges GROUP BY 1, 2 HAVING count(*) >= 5),
pairs AS (
  SELECT e.src_bank AS a_bank, e.src_account AS a_account, f.dst_bank AS c_bank, f.dst_account AS c_account, count(*) AS n_paths
  FROM edges e JOIN edges f ON e.dst_bank = f.src_bank AND e.dst_account = f.src_account
  WHERE e.src_bank <> f.dst_bank OR e.src_account <> f.dst_account GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
transfers AS (
  SELECT *, amount_paid * CASE payment_currency WHEN 'US Dollar' THEN 1.0e0 WHEN 'Euro' THEN 1.09e0 WHEN 'Bitcoin' THEN 42000.0e0 ELSE 1.0e0 END AS usd_paid
  FROM ledger WHERE payment_format IN ('Wire', 'ACH') AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-06')"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that follows the common expressions."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {LEDGER_SQL}\n{sql}"
        return f

    return put


FIVE = ("from_bank", "from_account", "to_bank", "to_account", "amount_paid")
TX = "tx_id, from_bank, from_account, amount_paid"


def _tx(rows: DataFrame) -> DataFrame:
    return rows.select("tx_id", "from_bank", "from_account", "amount_paid")


# Scans and projections


@query("SELECT tx_id, ts, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format FROM ledger")
def ledger_scan(spark, d):
    return L.ledger(spark, d).select("tx_id", "ts", "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "payment_currency", "payment_format")


@query("SELECT from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format, date_trunc('minute', ts) AS ts FROM ledger")
def csv_scan(spark, d):
    """The ledger written as transaction files, with zeros before bank ids and a label, and read by the positional reader."""
    path = storage.fresh(spark, "csv")
    rows = L.ledger(spark, d)
    file = rows.select(F.date_format("ts", "yyyy/MM/dd HH:mm").alias("Timestamp"), F.format_string("0%d", "from_bank").alias("From Bank"), F.col("from_account").alias("Account"), F.format_string("0%d", "to_bank").alias("To Bank"), F.col("to_account").alias("Account.1"), F.col("amount_received"), "receiving_currency", "amount_paid", "payment_currency", "payment_format", F.lit(0).alias("Is Laundering"))
    sinks.write_csv(file, path)
    return L.read_transactions(spark, path).select("from_bank", "from_account", "to_bank", "to_account", "amount_paid", "payment_currency", "payment_format", "ts")


@query("SELECT n_name AS bank_name, CAST(n_nationkey AS BIGINT) AS bank_id, CAST(c_custkey AS VARCHAR) AS account_number FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey")
def accounts_scan(spark, d):
    return L.accounts(spark, d).select("bank_name", "bank_id", "account_number")


@query("SELECT bank_name, bank_id, account_number, account_number AS entity_id, entity_name FROM (SELECT n_name AS bank_name, CAST(n_nationkey AS BIGINT) AS bank_id, CAST(c_custkey AS VARCHAR) AS account_number, c_name AS entity_name FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def accounts_csv(spark, d):
    """Accounts written as CSV files and read by the positional reader."""
    path = storage.fresh(spark, "csv")
    sinks.write_csv(L.accounts(spark, d).filter("account_number IS NOT NULL"), path)
    return L.read_accounts(spark, path)


@query("SELECT row_number() OVER (ORDER BY tx_id) - 1 AS n FROM usd")
def csv_index(spark, d):
    """Rows written to CSV behind a column that counts them."""
    path = storage.fresh(spark, "csv")
    sinks.write_csv(_tx(L.ledger(spark, d).filter(P.in_dollars())).repartition(5), path, index=True)
    return spark.read.csv(path, header=True).select(F.col("index").cast("long").alias("n"))


@query("SELECT tx_id, strftime(ts, '%Y/%m/%d %H:%M') AS short_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS long_text, strftime(ts, '%Y-%m-%d') AS day_text, date_trunc('minute', ts) AS short_ts, date_trunc('second', ts) AS long_ts FROM ledger")
def timestamp_parse(spark, d):
    rows = L.ledger(spark, d).select("tx_id", F.date_format("ts", "yyyy/MM/dd HH:mm").alias("short_text"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("long_text"))
    return rows.withColumns({"day_text": L.day_text(F.col("short_text")), "short_ts": L.parse_ts(F.col("short_text")), "long_ts": L.parse_ts(F.col("long_text"))})


@query(f"SELECT tx_id % 3 AS client_id, {TX} FROM ledger")
def client_stamp(spark, d):
    rows = L.ledger(spark, d)
    return rows.select((F.col("tx_id") % 3).alias("client_id"), "tx_id", "from_bank", "from_account", "amount_paid")


# Filters


@query(f"SELECT {TX} FROM ledger")
def filter_all(spark, d):
    return _tx(L.ledger(spark, d).filter(P.anything()))


@query("SELECT from_bank, from_account, to_bank, to_account, amount_paid FROM usd WHERE amount_paid < 50")
def uc1_low_value_usd(spark, d):
    return U.low_value(L.ledger(spark, d), S)


@query(f"SELECT {TX} FROM usd")
def filter_usd(spark, d):
    return _tx(L.ledger(spark, d).filter(P.in_dollars()))


@query(f"SELECT {TX} FROM a")
def filter_period_a(spark, d):
    return _tx(L.ledger(spark, d).filter(P.in_dollars() & S.baseline.holds()))


@query(f"SELECT {TX} FROM b")
def filter_period_b(spark, d):
    return _tx(L.ledger(spark, d).filter(P.in_dollars() & S.following.holds()))


@query(f"SELECT {TX} FROM transfers")
def filter_transfers(spark, d):
    return _tx(L.ledger(spark, d).filter(P.by_format(*S.formats) & S.baseline.holds()))


@query(f"""SELECT 'usd' AS route, {TX} FROM usd UNION ALL SELECT 'low', {TX} FROM usd WHERE amount_paid < 50 UNION ALL SELECT 'period_a', {TX} FROM a
UNION ALL SELECT 'period_b', {TX} FROM b UNION ALL SELECT 'graph', {TX} FROM a UNION ALL SELECT 'transfers', {TX} FROM transfers""")
def filter_fan_out(spark, d):
    """Six predicates in one pass over the ledger."""
    routes: dict[str, Column] = {
        "usd": P.in_dollars(), "low": P.in_dollars() & P.below(S.low_value), "period_a": P.in_dollars() & S.baseline.holds(),
        "period_b": P.in_dollars() & S.following.holds(), "graph": P.in_dollars() & S.baseline.holds(), "transfers": P.by_format(*S.formats) & S.baseline.holds(),
    }
    return P.routed(L.ledger(spark, d), routes).select("route", "tx_id", "from_bank", "from_account", "amount_paid")


@query("SELECT from_bank, from_account, to_bank, to_account, amount_paid FROM a WHERE (from_bank, from_account) IN (SELECT (from_bank, from_account) FROM a GROUP BY from_bank, from_account HAVING count(DISTINCT (to_bank, to_account)) BETWEEN 6 AND 9)")
def filter_fan_out_groups(spark, d):
    return A.fan_out_between(L.ledger(spark, d).filter(P.in_dollars() & S.baseline.holds()), 5, 10).select(*FIVE)


# Largest payment of each bank


@query("SELECT * FROM top")
def uc2_max_amount(spark, d):
    return A.largest_payment(L.ledger(spark, d).filter(P.in_dollars()))


@query("SELECT * FROM top")
def uc2_top1_window(spark, d):
    return A.largest_payment_by_rank(L.ledger(spark, d).filter(P.in_dollars()))


@query("SELECT * FROM top")
def uc2_max_one_pass(spark, d):
    return A.largest_payment_in_one_pass(L.ledger(spark, d).filter(P.in_dollars()))


@query("SELECT bank_id, bank_name FROM names")
def uc2_bank_names(spark, d):
    return A.bank_names(L.accounts(spark, d))


@query("SELECT from_bank, from_account, bank_name, amount_paid FROM top JOIN names ON from_bank = bank_id")
def uc2_bank_max(spark, d):
    return U.bank_max(L.ledger(spark, d), L.accounts(spark, d))


# Payments far below average


@query("SELECT payment_format, amount_sum, n FROM sums")
def uc3_format_sums(spark, d):
    return A.format_sums(L.ledger(spark, d).filter(P.in_dollars() & S.baseline.holds()))


@query("SELECT payment_format, amount_avg FROM average")
def uc3_format_averages(spark, d):
    return A.exact_format_averages(L.ledger(spark, d).filter(P.in_dollars() & S.baseline.holds()))


@query("SELECT tx_id, payment_format, amount_avg FROM b JOIN average USING (payment_format)")
def uc3_merged(spark, d):
    rows = L.ledger(spark, d).filter(P.in_dollars())
    return U.with_average(rows.filter(S.following.holds()), U.baseline_averages(rows, S, exact=True)).select("tx_id", "payment_format", "amount_avg")


@query("SELECT from_bank, from_account, b.payment_format, amount_paid FROM b JOIN average USING (payment_format) WHERE amount_paid < 0.01e0 * amount_avg")
def uc3_below_average(spark, d):
    return U.far_below_average(L.ledger(spark, d), S)


# Scatter-gather


def _edges(spark, d):
    return U.scatter_gather_edges(L.ledger(spark, d), S)


@query("SELECT * FROM edges")
def uc4_edges(spark, d):
    return _edges(spark, d)


@query("SELECT bank, account, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src_bank AS bank, src_account AS account, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst_bank, dst_account, 1, 0 FROM edges) GROUP BY 1, 2")
def uc4_neighbours(spark, d):
    return G.neighbours(_edges(spark, d))


@query("SELECT * FROM hi_out")
def uc4_high_out(spark, d):
    return G.high_out(_edges(spark, d), K)


@query("SELECT * FROM hi_in")
def uc4_high_in(spark, d):
    return G.high_in(_edges(spark, d), K)


@query("SELECT src_bank AS bank, src_account AS account FROM hi_out INTERSECT SELECT dst_bank, dst_account FROM hi_in")
def uc4_both_ends(spark, d):
    return G.both_ends(_edges(spark, d), K)


@query("SELECT e.* FROM edges e JOIN hi_out USING (src_bank, src_account)")
def uc4_pruned_first(spark, d):
    return G.first_hops(_edges(spark, d), K)


@query("SELECT e.* FROM edges e JOIN hi_in USING (dst_bank, dst_account)")
def uc4_pruned_second(spark, d):
    return G.second_hops(_edges(spark, d), K)


@query("SELECT * FROM pairs")
def uc4_pair_counts(spark, d):
    return G.pair_counts(_edges(spark, d), K)


@query("SELECT * FROM pairs")
def uc4_pair_counts_unpruned(spark, d):
    return G.pair_counts(_edges(spark, d), K, prune=False)


@query("SELECT * FROM pairs")
def uc4_pair_counts_salted(spark, d):
    return G.pair_counts(_edges(spark, d), K, salt=8)


@query("SELECT a_bank AS bank, a_account AS account FROM pairs UNION SELECT c_bank, c_account FROM pairs")
def uc4_accounts(spark, d):
    return U.scatter_gather(L.ledger(spark, d), S)


# Small transfers


@query("SELECT tx_id, usd_paid AS amount_paid, 'US Dollar' AS payment_currency FROM transfers")
def uc5_converted(spark, d):
    return U.converted(L.ledger(spark, d), R.fixed(spark), S).select("tx_id", "amount_paid", "payment_currency")


@query("SELECT tx_id, usd_paid AS amount_paid FROM transfers WHERE usd_paid < 1")
def uc5_amount_filter(spark, d):
    return U.converted(L.ledger(spark, d), R.fixed(spark), S).filter(P.below(S.under)).select("tx_id", "amount_paid")


@query("SELECT count(*) AS n_transfers FROM transfers WHERE usd_paid < 1")
def uc5_count(spark, d):
    return U.small_transfers(L.ledger(spark, d), R.fixed(spark), S)


def _daily_rates(spark):
    """A Euro that rises by a cent a day, and closes of Bitcoin for two days; other days have the fixed rates."""
    days = [dt.date(2024, 1, k) for k in range(1, 5)]
    by_day = {day: R.from_euro({"USD": 1.05 + 0.01 * k, "GBP": 0.84}, {code: name for name, code in R.CODES.items()}) for k, day in enumerate(days)}
    return R.daily(spark, by_day, {(days[0], "Bitcoin"): 41000.0, (days[2], "Bitcoin"): 43000.0}).union(R.fixed(spark))


DAILY_SQL = """SELECT tx_id, amount_paid * CASE WHEN payment_currency = 'Euro' AND ts < TIMESTAMP '2024-01-05' THEN 1.05e0 + 0.01e0 * (day(ts) - 1) WHEN payment_currency = 'Euro' THEN 1.09e0
  WHEN payment_currency = 'Bitcoin' AND day(ts) = 1 THEN 41000.0e0 WHEN payment_currency = 'Bitcoin' AND day(ts) = 3 THEN 43000.0e0 WHEN payment_currency = 'Bitcoin' THEN 42000.0e0 ELSE 1.0e0 END AS amount_paid FROM transfers"""


@query(DAILY_SQL)
def uc5_daily_converted(spark, d):
    """Rates by day, where a day and currency have one."""
    return U.converted(L.ledger(spark, d), _daily_rates(spark), S).select("tx_id", "amount_paid")


@query(f"SELECT count(*) AS n_transfers FROM ({DAILY_SQL}) WHERE amount_paid < 1")
def uc5_daily_count(spark, d):
    return U.small_transfers(L.ledger(spark, d), _daily_rates(spark), S)


# Sets, ranges, samples, clients, reports


@query("SELECT account, count(*) AS n_banks FROM (SELECT from_bank AS bank, from_account AS account FROM ledger UNION SELECT tx_id % 7, to_account FROM ledger) GROUP BY 1 HAVING count(*) > 1")
def multi_bank_accounts(spark, d):
    """Accounts of several banks, where the receiving bank differs by payment."""
    return A.accounts_of_several_banks(L.ledger(spark, d).withColumn("to_bank", F.col("tx_id") % 7))


@query("SELECT from_account AS account FROM ledger UNION ALL SELECT to_account FROM ledger")
def union_all_accounts(spark, d):
    rows = L.ledger(spark, d)
    return rows.select(F.col("from_account").alias("account")).union(rows.select("to_account"))


@query("SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM ledger")
def ts_range(spark, d):
    return A.time_range(L.ledger(spark, d))


@query(f"SELECT {TX} FROM ledger ORDER BY md5(concat_ws(':', 2026, tx_id)), tx_id LIMIT 100")
def sample_exact_n(spark, d):
    """A sampling operator: exactly 100 rows."""
    return _tx(sampling.exactly(L.ledger(spark, d), 100, "tx_id"))


@query("SELECT tx_id % 3 AS client_id, count(*) AS n_transfers FROM transfers WHERE usd_paid < 1 GROUP BY 1")
def clients_uc5_count(spark, d):
    rows = L.ledger(spark, d).withColumn("client_id", F.col("tx_id") % 3)
    return U.small_transfers(rows, R.fixed(spark), S, ("client_id",))


@query("SELECT client_id, from_bank, from_account, amount_paid FROM (SELECT *, row_number() OVER (PARTITION BY tx_id % 3, from_bank ORDER BY amount_paid DESC, from_account DESC) AS r, tx_id % 3 AS client_id FROM usd) WHERE r = 1")
def clients_uc2_max(spark, d):
    rows = L.ledger(spark, d).withColumn("client_id", F.col("tx_id") % 3)
    return A.largest_payment(rows.filter(P.in_dollars()), ("client_id",))


@query("SELECT tx_id % 3 AS client_id, tx_id, amount_paid FROM usd WHERE tx_id % 3 <> 1")
def clients_without_aborted(spark, d):
    rows = _tx(L.ledger(spark, d).filter(P.in_dollars())).withColumn("client_id", F.col("tx_id") % 3)
    aborted = spark.createDataFrame([(1,)], "client_id long")
    return jobs.without_clients(rows, aborted).select("client_id", "tx_id", "amount_paid")


@query("SELECT tx_id % 3 AS client_id, tx_id, amount_paid FROM usd")
def clients_sink(spark, d):
    """Written as a folder for each client, and read."""
    path = storage.fresh(spark, "clients")
    sinks.write_by_client(_tx(L.ledger(spark, d).filter(P.in_dollars())).withColumn("client_id", F.col("tx_id") % 3), path)
    return spark.read.parquet(path).select(F.col("client_id").cast("long").alias("client_id"), "tx_id", "amount_paid")


@query("SELECT concat('tx_id=', tx_id, ' from_account=', from_account, ' payment_format=', payment_format) AS line FROM a")
def debug_dump(spark, d):
    """Rows as lines to look at."""
    return sinks.dump(L.ledger(spark, d).filter(P.in_dollars() & S.baseline.holds()).select("tx_id", "from_account", "payment_format"))


def _report_sql(by: str = "", heads: str = "", joined: str = "") -> str:
    """Sections of the reports over the common expressions, or over those of clients."""
    c = "client_id, " if by else ""
    sections = [
        f"SELECT {c}printf('origin: %-20s destination: %-20s amount: %s', from_bank || '-' || from_account, to_bank || '-' || to_account, CAST(amount_paid AS VARCHAR)) AS line FROM {by}usd WHERE amount_paid < 50",
        f"SELECT {c}printf('bank_id: %-20s account: %-20s bank_name: %-30s amount: %s', CAST(from_bank AS VARCHAR), from_account, bank_name, CAST(amount_paid AS VARCHAR)) FROM {by}top JOIN names ON from_bank = bank_id",
        f"SELECT {c}printf('bank_id: %-20s account: %-20s payment_format: %-20s amount: %s', CAST(from_bank AS VARCHAR), from_account, payment_format, CAST(amount_paid AS VARCHAR)) FROM {by}b JOIN {by}average USING ({c}payment_format) WHERE amount_paid < 0.01e0 * amount_avg",
        f"SELECT {c}printf('bank: %-20s account: %s', CAST(bank AS VARCHAR), account) FROM (SELECT {c}a_bank AS bank, a_account AS account FROM {by}pairs UNION SELECT {c}c_bank, c_account FROM {by}pairs)",
        f"SELECT {c}printf('count: %s', CAST(count({'tx_id' if by else '*'}) AS VARCHAR)) FROM {joined or 'transfers WHERE usd_paid < 1'}",
    ]
    parts = [f"SELECT {c}{k} AS section, 0 AS part, '--- UC{k + 1} ---' AS line {heads}" for k in range(5)]
    return " UNION ALL ".join([*parts, *(f"SELECT {c}{k}, 1, line FROM ({q}) AS q{k}({c}line)" for k, q in enumerate(sections))])


@query(_report_sql())
def text_report(spark, d):
    """The lines of all five questions."""
    rows, names = L.ledger(spark, d), L.accounts(spark, d)
    return sinks.report({
        "UC1": reports.low_value(U.low_value(rows, S)), "UC2": reports.bank_max(U.bank_max(rows, names)), "UC3": reports.far_below_average(U.far_below_average(rows, S)),
        "UC4": reports.scatter_gather(U.scatter_gather(rows, S)), "UC5": reports.small_transfers(U.small_transfers(rows, R.fixed(spark), S)),
    })


CLIENTS_SQL = """, clients AS (SELECT DISTINCT tx_id % 3 AS client_id FROM ledger),
c_usd AS (SELECT *, tx_id % 3 AS client_id FROM usd), c_b AS (SELECT *, tx_id % 3 AS client_id FROM b),
c_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, from_bank ORDER BY amount_paid DESC, from_account DESC) AS r FROM c_usd) WHERE r = 1),
c_average AS (SELECT tx_id % 3 AS client_id, payment_format, avg(amount_paid) AS amount_avg FROM a GROUP BY 1, 2),
c_edges AS (SELECT DISTINCT tx_id % 3 AS client_id, from_bank AS src_bank, from_account AS src_account, to_bank AS dst_bank, to_account AS dst_account FROM a),
c_pairs AS (
  SELECT e.client_id, e.src_bank AS a_bank, e.src_account AS a_account, f.dst_bank AS c_bank, f.dst_account AS c_account FROM c_edges e JOIN c_edges f ON e.client_id = f.client_id AND e.dst_bank = f.src_bank AND e.dst_account = f.src_account
  WHERE e.src_bank <> f.dst_bank OR e.src_account <> f.dst_account GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 5)
"""


def _client_sections(spark, d):
    """The same for each of three clients, whose rows are kept apart throughout."""
    rows, by = L.ledger(spark, d).withColumn("client_id", F.col("tx_id") % 3), ("client_id",)
    clients = rows.select("client_id").distinct()
    counts = clients.join(U.small_transfers(rows, R.fixed(spark), S, by), "client_id", "left").fillna(0, ["n_transfers"])
    return clients, {
        "UC1": reports.low_value(U.low_value(rows, S, by), by), "UC2": reports.bank_max(U.bank_max(rows, L.accounts(spark, d), by), by), "UC3": reports.far_below_average(U.far_below_average(rows, S, by), by),
        "UC4": reports.scatter_gather(U.scatter_gather(rows, S, by), by), "UC5": reports.small_transfers(counts, by),
    }


@query(CLIENTS_SQL + _report_sql("c_", "FROM clients", "clients LEFT JOIN (SELECT tx_id, tx_id % 3 AS client_id FROM transfers WHERE usd_paid < 1) USING (client_id) GROUP BY client_id"))
def client_reports(spark, d):
    """A report for each client."""
    clients, sections = _client_sections(spark, d)
    return sinks.report(sections, ("client_id",), clients)


@query(CLIENTS_SQL + "SELECT client_id, line FROM (" + _report_sql("c_", "FROM clients", "clients LEFT JOIN (SELECT tx_id, tx_id % 3 AS client_id FROM transfers WHERE usd_paid < 1) USING (client_id) GROUP BY client_id") + ")")
def client_report_files(spark, d):
    """The reports as ordered text files in a folder for each client, read again."""
    clients, sections = _client_sections(spark, d)
    path = storage.fresh(spark, "reports")
    sinks.write_client_reports(sections, clients, path, ordered=True)
    return spark.read.text(path).select(F.col("client_id").cast("long").alias("client_id"), F.col("value").alias("line"))


@query("""SELECT 1 AS uc, count(*) AS n FROM usd WHERE amount_paid < 50 UNION ALL SELECT 2, count(*) FROM top JOIN names ON from_bank = bank_id
UNION ALL SELECT 3, count(*) FROM b JOIN average USING (payment_format) WHERE amount_paid < 0.01e0 * amount_avg
UNION ALL SELECT 4, count(*) FROM (SELECT a_bank, a_account FROM pairs UNION SELECT c_bank, c_account FROM pairs) UNION ALL SELECT 5, count(*) FROM transfers WHERE usd_paid < 1""")
def all_usecases(spark, d):
    """Numbers of results of the five questions."""
    rows, names = L.ledger(spark, d), L.accounts(spark, d)
    n = lambda k, df: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("uc"), "n")
    parts = [n(1, U.low_value(rows, S)), n(2, U.bank_max(rows, names)), n(3, U.far_below_average(rows, S)), n(4, U.scatter_gather(rows, S))]
    out = U.small_transfers(rows, R.fixed(spark), S).select(F.lit(5).alias("uc"), F.col("n_transfers").alias("n"))
    for p in parts:
        out = out.unionByName(p)
    return out


# Streams


@query("SELECT from_bank, from_account, to_bank, to_account, amount_paid FROM usd WHERE amount_paid < 50")
def stream_low_value(spark, d):
    return jobs.low_value(spark, d)


@query("SELECT * FROM top")
def stream_bank_max(spark, d):
    return jobs.bank_max(spark, d)


@query("SELECT payment_format, amount_avg FROM average")
def stream_format_averages(spark, d):
    return jobs.format_averages(spark, d)


@query("SELECT from_bank, from_account, b.payment_format, amount_paid FROM b JOIN average USING (payment_format) WHERE amount_paid < 0.01e0 * amount_avg")
def stream_below_average(spark, d):
    return jobs.far_below_average(spark, d)


@query("SELECT count(*) AS n_transfers FROM transfers WHERE usd_paid < 1")
def stream_small_transfers(spark, d):
    return jobs.small_transfers(spark, d)


@query(f"SELECT {TX} FROM ledger")
def stream_dedup(spark, d):
    return jobs.deduplicated(spark, d)


@query("SELECT client_id, from_bank, from_account, amount_paid FROM (SELECT *, row_number() OVER (PARTITION BY tx_id % 3, from_bank ORDER BY amount_paid DESC, from_account DESC) AS r, tx_id % 3 AS client_id FROM usd) WHERE r = 1")
def stream_clients_bank_max(spark, d):
    """Several clients in one stream."""
    return jobs.bank_max(spark, d, ("client_id",), clients=3)


@query("SELECT tx_id % 3 AS client_id, count(*) AS n_transfers FROM transfers WHERE usd_paid < 1 GROUP BY 1")
def stream_clients_small_transfers(spark, d):
    return jobs.small_transfers(spark, d, by=("client_id",), clients=3)


@query("SELECT tx_id % 3 AS client_id, from_bank, from_account, to_bank, to_account, amount_paid FROM usd WHERE amount_paid < 50 AND tx_id % 3 <> 1")
def stream_clients_without_aborted(spark, d):
    """The rows of a client that has gone are dropped from the stream."""
    return jobs.low_value(spark, d, by=("client_id",), clients=3, aborted=spark.range(1, 2).toDF("client_id"))
