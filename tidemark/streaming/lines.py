"""Ledgers from streams of text lines: sockets, and message queues where Spark has a connector.

A line is a transaction of eleven fields separated by commas, as in the files. The source
decides what a stream promises: a queue with offsets can be read again after a failure, a
socket can't. Lines that aren't transactions fail the query, or are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schema
from tidemark.sources.ledgers import parse_ts


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """value: the lines that a TCP server sends; for trials, as lines that were read are lost with the query."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def queue_lines(spark: SparkSession, servers: str, topic: str, per_batch: int | None = None, **options: str) -> DataFrame:
    """value: the messages of a topic, from its beginning; needs Spark's Kafka connector among its packages."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").options(**options)
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def transactions(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """A ledger of the column value; a line with missing or malformed fields fails, or is left out."""
    parsed = F.from_csv("value", schema.LEDGER_CSV.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE"})
    rows = lines.select("value", parsed.alias("r"))
    bad = F.exists(F.array(*[F.col(f"r.{c}").isNull() for c in schema.LEDGER_CSV.names]), lambda x: x)
    if lenient:
        rows = rows.filter(~bad)
    else:
        rows = rows.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("not a transaction: "), F.col("value"))).cast(schema.LEDGER_CSV)).otherwise(F.col("r")))
    return rows.select("r.*").withColumn("ts", parse_ts(F.col("ts_text"))).select(*schema.LEDGER.names)
