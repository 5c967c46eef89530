"""A corpus in five stages: quality rules, near-dedup, decontamination, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and reads it again for the next one. All but the last
return the columns that they were given.

Cases that a stage's operator defines hold here too. Beyond them: near-dedup keeps rows
whose id is null, and one row of those with the same id and text; a text that is null stays null
until the secret scan, which makes it empty. The learned rules and the near-duplicate
groups have no SQL, so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, near_dedup, piece_codec, quality_rules, secret_scan, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the decision list learned from `labels`."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.passed(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    found, _ = shared.written(near_dedup.near_duplicates(docs), "near")
    gone, _ = shared.written(found.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    # A bounded number of ids is broadcast, so that the texts stay where they are; more are joined by a shuffle.
    few = gone.count() <= near_dedup.BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if few else gone.hint("merge"), F.col("doc_id") == F.col("_gone"), "left_anti")
    repeated = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return out
    return out.filter("doc_id IS NULL").union(out.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rows = secret_scan.redacted(docs, keep=rest)
    columns = {c: F.col("kept")[c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("found") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return rows.select(*[columns[c].alias(c) for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the ids of their pieces and whether these decode to the text."""
    return piece_codec.encoded(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontaminate", clean_of_benchmarks),
    ("secret_scan", without_secrets),
    ("piece_codec", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
