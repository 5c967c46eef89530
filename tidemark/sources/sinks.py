"""Sinks: text reports, one folder per client, CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import storage


def float_text(amount: str | Column) -> Column:
    """A double as the shortest decimal with a fraction, without an exponent from 1e-4 up to 1e16."""
    c = F.col(amount) if isinstance(amount, str) else amount
    text, size = c.cast("string"), F.abs(c)
    # From 1e7 on Spark writes an exponent; the digits stay the same.
    large = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ".0")
    return F.when((size >= 1e7) & (size < 1e16), large).when((size >= 1e-4) & (size < 1e-3), plain_small(c)).otherwise(text)


def plain_small(c: Column) -> Column:
    """A double in [1e-4, 1e-3) without its exponent: the same digits behind zeros."""
    digits = F.regexp_replace(F.regexp_extract(F.abs(c).cast("string"), r"^([\d.]+)E", 1), r"\.0$|\.", "")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("0.000"), digits)


def dump(rows: DataFrame) -> DataFrame:
    """Every row as a line of names and values, to look at or to write as text; nulls are named."""
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))
    return rows.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), value(c)) for c in rows.columns]).alias("line"))


def report(sections: dict[str, DataFrame], by: tuple[str, ...] = (), clients: DataFrame | None = None) -> DataFrame:
    """(section, part, line) of one report: a header, then the lines of each. With `by`, of a report for each of `clients`.

    Sections have the columns of `by` and one more.
    """
    titles = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(0).alias("part"), F.lit(f"--- {t} ---").alias("line")) for k, t in enumerate(sections)])
    first = next(iter(sections.values()))
    heads = clients if clients is not None else first.sparkSession.range(1).select()
    parts = [heads.select(*by, F.explode(titles).alias("_t")).select(*by, "_t.*")]
    for k, lines in enumerate(sections.values()):
        parts.append(lines.toDF(*by, "line").select(*by, F.lit(k).alias("section"), F.lit(1).alias("part"), F.col("line").cast("string").alias("line")))
    return reduce(DataFrame.unionByName, parts)


def write_report(sections: dict[str, DataFrame], path: str, ordered: bool = False) -> None:
    """Text files whose names are in the order of the sections. A section's lines are spread over files, in order or, by default, in none."""
    _in_order(report(sections), (), ordered).select("line").write.text(path)


def write_client_reports(sections: dict[str, DataFrame], clients: DataFrame, path: str, client: str = "client_id", ordered: bool = False) -> None:
    """The same in a folder for each client."""
    _in_order(report(sections, (client,), clients), (client,), ordered).select(client, "line").write.partitionBy(client).text(path)


def _in_order(rows: DataFrame, by: tuple[str, ...], ordered: bool) -> DataFrame:
    # A section is split by its lines, or by their hashes.
    order = [*by, "section", "part", F.col("line") if ordered else F.xxhash64("line")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_by_client(rows: DataFrame, path: str, client: str = "client_id") -> None:
    """A folder for each client; a client's rows may be in several files."""
    rows.write.partitionBy(client).parquet(path)


def numbered(rows: DataFrame, name: str = "index") -> DataFrame:
    """rows with a first column that counts them from 0 without gaps; in no given order, and the same whenever it is read.

    Rows are written once; their places within a task, and the tasks' sizes, make the numbers. Only the sizes are gathered.
    """
    held = storage.written(rows.select(F.monotonically_increasing_id().alias("_at"), *rows.columns), "numbered")[0]
    task = F.shiftright("_at", 33).alias("_task")
    sizes = held.groupBy(task).agg(F.count("*").alias("_n"))
    before = sizes.select("_task", (F.sum("_n").over(W.orderBy("_task")) - F.col("_n")).alias("_before"))  # a row a task
    out = held.withColumn("_task", task).join(F.broadcast(before), "_task")
    return out.select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name), *rows.columns)


def write_csv(rows: DataFrame, path: str, index: bool = False) -> None:
    """CSV with a header, also where there are no rows; with `index`, behind a column that counts them from 0."""
    (numbered(rows) if index else rows).write.csv(path, header=True)
