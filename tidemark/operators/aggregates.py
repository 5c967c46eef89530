"""Keyed aggregates. Each plans as a partial aggregate, a shuffle on its keys, and a final one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

Keys = tuple[str, ...]


def largest_payment(rows: DataFrame, by: Keys = ()) -> DataFrame:
    """Per bank, the largest amount and the account that paid it; of equal amounts the largest account.

    Amounts alone are aggregated by hash; the few rows that reach their bank's maximum then give the
    account. Aggregating (amount, account) together would sort every row: Spark has no hash aggregate
    for structs and strings. Amounts that are null are never the largest; a bank with no others is left out.
    """
    rows = rows.filter(F.col("amount_paid").isNotNull())
    top = rows.groupBy(*by, "from_bank").agg(F.max("amount_paid").alias("amount_paid"))
    at_top = rows.select(*by, "from_bank", "from_account", "amount_paid").join(top, [*by, "from_bank", "amount_paid"], "left_semi")
    return at_top.groupBy(*by, "from_bank", "amount_paid").agg(F.max("from_account").alias("from_account")).select(*by, "from_bank", "from_account", "amount_paid")


def largest_payment_in_one_pass(rows: DataFrame, by: Keys = ()) -> DataFrame:
    """The same as one aggregate, for streams, which can't read their rows twice."""
    top = F.max(F.struct("amount_paid", "from_account"))
    return rows.filter(F.col("amount_paid").isNotNull()).groupBy(*by, "from_bank").agg(top.alias("_top")).select(*by, "from_bank", F.col("_top.from_account").alias("from_account"), F.col("_top.amount_paid").alias("amount_paid"))


def largest_payment_by_rank(rows: DataFrame, by: Keys = ()) -> DataFrame:
    """The same by a window; Spark prunes each partition to its first row before the shuffle."""
    order = W.partitionBy(*by, "from_bank").orderBy(F.desc("amount_paid"), F.desc("from_account"))
    return rows.filter(F.col("amount_paid").isNotNull()).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(*by, "from_bank", "from_account", "amount_paid")


def bank_names(accounts: DataFrame, by: Keys = ()) -> DataFrame:
    """One name a bank; of several the first in order. Distinct names come first: that is a hash aggregate, and leaves few rows."""
    return accounts.select(*by, "bank_id", "bank_name").distinct().groupBy(*by, "bank_id").agg(F.min("bank_name").alias("bank_name"))


def format_sums(rows: DataFrame, by: Keys = ()) -> DataFrame:
    """Exact sums of cents and counts per payment format: what partial averages are made of."""
    return rows.groupBy(*by, "payment_format").agg(F.sum(F.col("amount_paid").cast("decimal(18,2)")).cast("double").alias("amount_sum"), F.count("amount_paid").alias("n"))


def format_averages(rows: DataFrame, by: Keys = ()) -> DataFrame:
    """Averages of doubles per payment format."""
    return rows.groupBy(*by, "payment_format").agg(F.avg("amount_paid").alias("amount_avg"))


def exact_format_averages(rows: DataFrame, by: Keys = ()) -> DataFrame:
    """Averages that don't depend on the order of rows; amounts have two decimals."""
    return format_sums(rows, by).select(*by, "payment_format", (F.col("amount_sum") / F.col("n")).alias("amount_avg"))


def time_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def accounts_of_several_banks(rows: DataFrame) -> DataFrame:
    """Account numbers that occur with more than one bank, on either side of a payment."""
    both = rows.select(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")).union(rows.select("to_bank", "to_account"))
    return both.distinct().groupBy("account").agg(F.count("*").alias("n_banks")).filter("n_banks > 1")


def fan_out_between(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Payments of accounts whose number of different receivers lies strictly between low and high."""
    payer = ["from_bank", "from_account"]
    fan = rows.groupBy(*payer).agg(F.countDistinct("to_bank", "to_account").alias("n_to")).filter((F.col("n_to") > low) & (F.col("n_to") < high))
    return rows.join(fan.select(*payer), payer, "left_semi")
