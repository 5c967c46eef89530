"""Text lines of the five questions, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.sources.sinks import float_text

Keys = tuple[str, ...]

# The lines of each section. Values are filled with spaces to their width and never cut.
LOW_VALUE = "origin: %-20s destination: %-20s amount: %s"
BANK_MAX = "bank_id: %-20s account: %-20s bank_name: %-30s amount: %s"
FAR_BELOW_AVERAGE = "bank_id: %-20s account: %-20s payment_format: %-20s amount: %s"
SCATTER_GATHER = "bank: %-20s account: %s"
SMALL_TRANSFERS = "count: %s"


def _lines(rows: DataFrame, by: Keys, pattern: str, *values: str | Column) -> DataFrame:
    return rows.select(*by, F.format_string(pattern, *[(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]).alias("line"))


def _node(side: str) -> Column:
    return F.concat_ws("-", F.col(f"{side}_bank").cast("string"), F.col(f"{side}_account"))


def low_value(rows: DataFrame, by: Keys = ()) -> DataFrame:
    return _lines(rows, by, LOW_VALUE, _node("from"), _node("to"), float_text("amount_paid"))


def bank_max(rows: DataFrame, by: Keys = ()) -> DataFrame:
    return _lines(rows, by, BANK_MAX, "from_bank", "from_account", "bank_name", float_text("amount_paid"))


def far_below_average(rows: DataFrame, by: Keys = ()) -> DataFrame:
    return _lines(rows, by, FAR_BELOW_AVERAGE, "from_bank", "from_account", "payment_format", float_text("amount_paid"))


def scatter_gather(rows: DataFrame, by: Keys = ()) -> DataFrame:
    return _lines(rows, by, SCATTER_GATHER, "bank", "account")


def small_transfers(rows: DataFrame, by: Keys = ()) -> DataFrame:
    return _lines(rows, by, SMALL_TRANSFERS, "n_transfers")
