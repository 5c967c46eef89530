"""Row predicates of the plans, as Column expressions that reach the scan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

DOLLAR = "US Dollar"


@dataclass(frozen=True)
class Period:
    """Days from `first` to `last`, both included."""

    first: dt.date
    last: dt.date

    def holds(self, ts: str = "ts") -> Column:
        """A half-open range of timestamps, which a Parquet scan can prune by."""
        low, high = self.first, self.last + dt.timedelta(days=1)
        return (F.col(ts) >= F.lit(f"{low} 00:00:00").cast("timestamp_ntz")) & (F.col(ts) < F.lit(f"{high} 00:00:00").cast("timestamp_ntz"))


#: The same days of the month in the ledgers' year and in the test tables'.
BASELINE, FOLLOWING = Period(dt.date(2022, 9, 1), dt.date(2022, 9, 5)), Period(dt.date(2022, 9, 6), dt.date(2022, 9, 15))
EVENTS_BASELINE, EVENTS_FOLLOWING = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 5)), Period(dt.date(2024, 1, 6), dt.date(2024, 1, 15))


def anything() -> Column:
    return F.lit(True)


def in_dollars() -> Column:
    return F.col("payment_currency") == DOLLAR


def below(limit: float, amount: str = "amount_paid") -> Column:
    return F.col(amount) < F.lit(float(limit))


def by_format(*formats: str) -> Column:
    return F.col("payment_format").isin(*formats)


def routed(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Every row once for each predicate that it meets, with the predicate's name in `route`; one pass over the rows."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in predicates.items()]))
    return rows.withColumn("route", F.explode(names))
