"""Readers: ledgers and accounts from CSV files, and from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark import schema

FORMATS = {"click": "Wire", "error": "ACH", "purchase": "Cheque", "signup": "Credit Card", "view": "Reinvestment"}
BANKS = 25


def parse_ts(text: Column) -> Column:
    """`yyyy/MM/dd HH:mm` or `yyyy-MM-dd HH:mm:ss`, as a timestamp without a zone; anything else fails."""
    slashes = F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm"))
    dashes = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    bad = F.raise_error(F.concat(F.lit("not a timestamp: "), text)).cast("timestamp")
    return F.coalesce(slashes, dashes, F.when(text.isNotNull(), bad)).cast("timestamp_ntz")


def day_text(text: Column) -> Column:
    """The day of a timestamp's text, with dashes."""
    return F.translate(F.substring(text, 1, 10), "/", "-")


def _csv(spark: SparkSession, path: str, columns: T.StructType, lenient: bool) -> DataFrame:
    """Rows by position. A malformed line fails; if lenient, lines with a missing or malformed field are left out."""
    if not lenient:
        return spark.read.schema(columns).csv(path, header=True, enforceSchema=True, mode="FAILFAST")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in columns.names])
    rows = spark.read.schema(texts).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE")
    values = [F.col(c.name).try_cast(c.dataType).alias(c.name) for c in columns]
    return rows.select(*values).dropna()


def read_transactions(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """A ledger from CSV files of 11 positional fields; bank ids lose leading zeros; a malformed line fails, or is left out."""
    rows = _csv(spark, path, schema.LEDGER_CSV, lenient)
    return rows.withColumn("ts", parse_ts(F.col("ts_text"))).select(*schema.LEDGER.names)


def read_accounts(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    return _csv(spark, path, schema.ACCOUNTS, lenient)


def ledger_of(events: DataFrame) -> DataFrame:
    """A ledger from event rows: users pay the account in their properties; one in ten pays Euro, one Bitcoin."""
    to = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    currency = F.when(F.col("event_id") % 10 < 8, "US Dollar").when(F.col("event_id") % 10 == 8, "Euro").otherwise("Bitcoin")
    return events.select(
        F.col("event_id").alias("tx_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % BANKS).alias("from_bank"), F.col("user_id").cast("string").alias("from_account"),
        (to % BANKS).alias("to_bank"), to.cast("string").alias("to_account"), F.col("value").alias("amount_received"), currency.alias("receiving_currency"),
        F.col("value").alias("amount_paid"), currency.alias("payment_currency"), F.try_element_at(kind, F.col("event_type")).alias("payment_format"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks are nations; each has one account per customer of the nation."""
    nation, customer = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "right")
    return rows.select(F.col("n_name").alias("bank_name"), F.col("n_nationkey").cast("long").alias("bank_id"), F.col("c_custkey").cast("string").alias("account_number"), F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("entity_name"))
