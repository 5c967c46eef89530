"""The five ledger questions. Thresholds and periods are parameters; `by` keeps several clients apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark import storage
from tidemark.functions import predicates as P
from tidemark.operators import aggregates as A, graph as G
from tidemark.sources import rates as R

Keys = tuple[str, ...]


@dataclass(frozen=True)
class Settings:
    low_value: float = 50.0
    below_share: float = 0.01
    intermediaries: int = 5
    under: float = 1.0
    formats: tuple[str, ...] = ("Wire", "ACH")
    baseline: P.Period = P.BASELINE
    following: P.Period = P.FOLLOWING


EVENTS = Settings(baseline=P.EVENTS_BASELINE, following=P.EVENTS_FOLLOWING)


def low_value(ledger: DataFrame, s: Settings = Settings(), by: Keys = ()) -> DataFrame:
    """Dollar payments under the limit; a bag of rows."""
    return ledger.filter(P.in_dollars() & P.below(s.low_value)).select(*by, "from_bank", "from_account", "to_bank", "to_account", "amount_paid")


def bank_max(ledger: DataFrame, accounts: DataFrame, by: Keys = ()) -> DataFrame:
    """Each bank's largest Dollar payment, with the bank's name; banks without a name are left out."""
    top = A.largest_payment(ledger.filter(P.in_dollars()), by)
    names = A.bank_names(accounts)
    return top.join(names, F.col("from_bank") == F.col("bank_id")).select(*by, "from_bank", "from_account", "bank_name", "amount_paid")


def with_average(later: DataFrame, average: DataFrame, by: Keys = ()) -> DataFrame:
    """Payments with their format's average. Averages are a written table; a small one is broadcast, and the payments stay where they are."""
    return later.join(storage.small(average), [*by, "payment_format"])


def baseline_averages(dollars: DataFrame, s: Settings = Settings(), by: Keys = (), exact: bool = False) -> DataFrame:
    """Averages of the baseline by format, written: before, Spark takes their size for the ledger's."""
    return storage.written((A.exact_format_averages if exact else A.format_averages)(dollars.filter(s.baseline.holds()), by), "averages")[0]


def far_below_average(ledger: DataFrame, s: Settings = Settings(), by: Keys = (), exact: bool = False) -> DataFrame:
    """Dollar payments of the following period under a share of their format's average in the baseline."""
    dollars = ledger.filter(P.in_dollars())
    later = with_average(dollars.filter(s.following.holds()), baseline_averages(dollars, s, by, exact), by)
    return later.filter(F.col("amount_paid") < F.lit(s.below_share) * F.col("amount_avg")).select(*by, "from_bank", "from_account", "payment_format", "amount_paid")


def scatter_gather_edges(ledger: DataFrame, s: Settings = Settings(), by: Keys = ()) -> DataFrame:
    return G.edges(ledger.filter(P.in_dollars() & s.baseline.holds()), by)


def scatter_gather(ledger: DataFrame, s: Settings = Settings(), by: Keys = (), salt: int | None = None) -> DataFrame:
    """Accounts at either end of a pair with enough different intermediaries."""
    return G.endpoints(G.pair_counts(scatter_gather_edges(ledger, s, by), s.intermediaries, by, salt=salt), by)


def converted(ledger: DataFrame, rates: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Payments of the counted formats in the baseline, any currency, in Dollars."""
    return R.converted(ledger.filter(P.by_format(*s.formats) & s.baseline.holds()), rates)


def small_transfers(ledger: DataFrame, rates: DataFrame, s: Settings = Settings(), by: Keys = ()) -> DataFrame:
    """How many of them are under the threshold; 0 if there are none."""
    rows = converted(ledger, rates, s).filter(P.below(s.under))
    return rows.groupBy(*by).agg(F.count("*").alias("n_transfers")) if by else rows.agg(F.count("*").alias("n_transfers"))
