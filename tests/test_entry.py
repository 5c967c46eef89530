"""The driver contract."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 48


def test_the_core_does_not_import_the_extras():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"tidemark\.llm|corpus_pipeline", p.read_text()), p


def test_entry_has_rows(spark, data):
    assert entry.entry(spark).count() > 0
