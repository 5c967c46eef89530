"""Queries of the training-data operators that SQL can express, against DuckDB, and the contracts' columns."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.llm import registry

#: Columns that each query must have, in any order; more may follow.
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_near_dedup": "doc_id n_shingles component_id kept", "op5_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op6_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score", "op9_url_filter": "page_id host path rule verdict", "op10_html_extract": "page_id url text n_chars",
}


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(["null" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row]) for row in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    d = f"{data}/sf0.001"
    c = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        path = f"{d}/{table}.parquet"
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = registry.QUERIES[name](spark, d).toPandas(), c.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, data, name):
    df = registry.QUERIES[name](spark, f"{data}/sf0.001")
    kinds = dict(df.dtypes)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    for column in COLUMNS[name].split():
        if column.startswith("n_") or column in ("doc_id", "page_id", "first_word", "last_word", "word_chars", "component_id", "train_tokens"):
            assert kinds[column] == "bigint"
        elif "score" in column:
            assert kinds[column] == "double"
        else:
            assert kinds[column] in ("string", "boolean")
