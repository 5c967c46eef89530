"""Exchange rates to the US Dollar, as a dimension table (day, currency, usd_rate)."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import storage

#: Offline rates that hold on every day (day is null).
DEFAULT = {"US Dollar": 1.0, "Euro": 1.09, "Bitcoin": 42000.0}

# Currency names of the ledgers, and their codes at rate services.
CODES = {
    "Australian Dollar": "AUD",
    "Brazil Real": "BRL",
    "Canadian Dollar": "CAD",
    "Euro": "EUR",
    "Mexican Peso": "MXN",
    "Rupee": "INR",
    "Shekel": "ILS",
    "Swiss Franc": "CHF",
    "UK Pound": "GBP",
    "US Dollar": "USD",
    "Yen": "JPY",
    "Yuan": "CNY",
}
# Dollars for currencies that rate services lack.
CONSTANT = {
    "Bitcoin": 78.33,
    "Ruble": 0.01,
    "Saudi Riyal": 0.27,
}
# Daily closes of Bitcoin, in Dollars.
BITCOIN = {
    dt.date(2022, 9, 1): 20131.46,
    dt.date(2022, 9, 2): 19951.86,
    dt.date(2022, 9, 3): 19831.90,
    dt.date(2022, 9, 4): 20000.30,
    dt.date(2022, 9, 5): 19796.84,
}
_SCHEMA = pa.schema([("day", pa.date32()), ("currency", pa.string()), ("usd_rate", pa.float64())])
RATES = "day date, currency string, usd_rate double"


def _table(spark: SparkSession, rows: list[tuple[dt.date | None, str, float]]) -> DataFrame:
    """Rows as part of the plan, so that their size is known to it."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA))


def fixed(spark: SparkSession, rates: Mapping[str, float] = DEFAULT) -> DataFrame:
    """The same rates on every day."""
    return _table(spark, [(None, c, float(r)) for c, r in rates.items()])


def daily(spark: SparkSession, by_day: Mapping[dt.date, Mapping[str, float]], override: Mapping[tuple[dt.date, str], float] | None = None) -> DataFrame:
    """Rates by day; `override` replaces single ones, as for a currency with its own daily close."""
    rows = {(day, c): float(r) for day, rates in by_day.items() for c, r in rates.items()}
    rows |= {k: float(v) for k, v in (override or {}).items()}
    return _table(spark, [(d, c, r) for (d, c), r in sorted(rows.items())])


def of_service(spark: SparkSession, per_euro_by_day: Mapping[dt.date, Mapping[str, float]]) -> DataFrame:
    """Rates by day from a service's answers, with the constants, and the closes of Bitcoin on the days that have one."""
    by_day = {day: from_euro(rates, {code: name for name, code in CODES.items()}, CONSTANT) for day, rates in per_euro_by_day.items()}
    return daily(spark, by_day, {(day, "Bitcoin"): close for day, close in BITCOIN.items() if day in by_day})


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATES).csv(path, header=True, mode="FAILFAST")


def from_euro(per_euro: Mapping[str, float], names: Mapping[str, str], constant: Mapping[str, float] | None = None) -> dict[str, float]:
    """Units per Euro by code, as a rate service gives them, turned into US Dollars per unit by currency name."""
    dollars = per_euro["USD"]
    out = {names[code]: dollars / rate for code, rate in per_euro.items() if code in names}
    if "EUR" in names:
        out[names["EUR"]] = dollars
    return out | dict(constant or {})


def fetched(days: Iterable[dt.date], fetch: Callable[[dt.date], Mapping[str, float]], base: float = 1.0, cap: float = 30.0, attempts: int = 10, sleep: Callable[[float], None] = time.sleep) -> dict[dt.date, Mapping[str, float]]:
    """One call a day, retried with a pause that doubles from `base` up to `cap`; the last failure is raised."""
    out = {}
    for day in sorted(set(days)):
        for k in range(attempts):
            try:
                out[day] = fetch(day)
                break
            except OSError:
                if k == attempts - 1:
                    raise
                sleep(min(cap, base * 2**k))
    return out


def converted(rows: DataFrame, rates: DataFrame, day: str = "ts", currency: str = "payment_currency", amount: str = "amount_paid") -> DataFrame:
    """rows with `amount` in US Dollars: a rate of the day, else one that holds always, else 1.

    Rates whose size is known to be small are broadcast, so that the rows stay where they are; others are joined by a shuffle.
    """
    of_day = rates.filter("day IS NOT NULL").groupBy(F.col("day").alias("_day"), F.col("currency").alias("_c1")).agg(F.max("usd_rate").alias("_r1"))
    always = rates.filter("day IS NULL").groupBy(F.col("currency").alias("_c2")).agg(F.max("usd_rate").alias("_r2"))
    of_day, always = storage.small(of_day), storage.small(always)
    out = rows.join(of_day, (F.to_date(day) == F.col("_day")) & (F.col(currency) == F.col("_c1")), "left").join(always, F.col(currency) == F.col("_c2"), "left")
    rate = F.coalesce("_r1", "_r2", F.lit(1.0))
    return out.withColumn(amount, F.col(amount) * rate).withColumn(currency, F.lit("US Dollar")).drop("_day", "_c1", "_r1", "_c2", "_r2")
