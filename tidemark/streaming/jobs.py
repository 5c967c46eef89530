"""Structured Streaming forms of the plans. Each runs over what its source has now, and stops.

Sources are files; `availableNow` ends a query when the files present at its start are
read, which stands for the counted end of a client's stream. Offsets, state and output
commits are in the checkpoint folder, so a query that is started again goes on exactly
once. Outputs are files: nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import storage
from tidemark.functions import predicates as P
from tidemark.operators import aggregates as A
from tidemark.plans.usecases import EVENTS, Keys, Settings, with_average
from tidemark.sources import ledgers, rates


def events_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The event table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}*")


def appended(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs an append-mode query into files and reads them."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def completed(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a complete-mode aggregate; each batch writes its own table, again if it is repeated, and the last one is read."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return spark.createDataFrame([], stream.schema)
    last = max(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(where))
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={last}")


def _run(how: Callable[[DataFrame, str, str], DataFrame], stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    return how(stream, storage.fresh(spark, "stream"), storage.fresh(spark, "offsets"))


def ledger_stream(spark: SparkSession, sf_dir: str, clients: int = 0) -> DataFrame:
    """The ledger as a stream; of several clients, by payment number, if their number is given."""
    rows = ledgers.ledger_of(events_stream(spark, sf_dir))
    return rows.withColumn("client_id", F.col("tx_id") % clients) if clients else rows


def low_value(spark: SparkSession, sf_dir: str, s: Settings = EVENTS, by: Keys = (), clients: int = 0, aborted: DataFrame | None = None) -> DataFrame:
    rows = ledger_stream(spark, sf_dir, clients).filter(P.in_dollars() & P.below(s.low_value))
    rows = rows if aborted is None else without_clients(rows, aborted)
    return _run(appended, rows.select(*by, "from_bank", "from_account", "to_bank", "to_account", "amount_paid"))


def bank_max(spark: SparkSession, sf_dir: str, by: Keys = (), clients: int = 0) -> DataFrame:
    return _run(completed, A.largest_payment_in_one_pass(ledger_stream(spark, sf_dir, clients).filter(P.in_dollars()), by))


def format_averages(spark: SparkSession, sf_dir: str, s: Settings = EVENTS, by: Keys = (), clients: int = 0) -> DataFrame:
    return _run(completed, A.exact_format_averages(ledger_stream(spark, sf_dir, clients).filter(P.in_dollars() & s.baseline.holds()), by))


def far_below_average(spark: SparkSession, sf_dir: str, s: Settings = EVENTS, by: Keys = (), clients: int = 0) -> DataFrame:
    """Two streams one after the other: the averages are complete before the later payments meet them."""
    average = format_averages(spark, sf_dir, s, by, clients)
    later = with_average(ledger_stream(spark, sf_dir, clients).filter(P.in_dollars() & s.following.holds()), average, by)
    return _run(appended, later.filter(F.col("amount_paid") < F.lit(s.below_share) * F.col("amount_avg")).select(*by, "from_bank", "from_account", "payment_format", "amount_paid"))


def small_transfers(spark: SparkSession, sf_dir: str, s: Settings = EVENTS, by: Keys = (), clients: int = 0) -> DataFrame:
    rows = rates.converted(ledger_stream(spark, sf_dir, clients).filter(P.by_format(*s.formats) & s.baseline.holds()), rates.fixed(spark)).filter(P.below(s.under))
    n = F.count("*").alias("n_transfers")
    return _run(completed, rows.groupBy(*by).agg(n) if by else rows.agg(n))


def deduplicated(spark: SparkSession, sf_dir: str, late: str = "60 days") -> DataFrame:
    """Each payment once, though the stream brings it twice; state is kept as long as events may be late."""
    rows = ledger_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = rows.union(rows)
    once = twice.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tx_id"])
    return _run(appended, once.select("tx_id", "from_bank", "from_account", "amount_paid"))


def without_clients(rows: DataFrame, aborted: DataFrame, client: str = "client_id") -> DataFrame:
    """Rows of clients that weren't aborted; works on a stream against a table of aborted clients."""
    return rows.join(aborted.select(client).distinct(), client, "left_anti")
