"""License scans: word grams joined with template positions vote for offset diagonals.

Every three neighbouring words of every document (two for the shortest templates) are
joined, by hash and then word by word, with the positions of the license templates. A match
of document word p with template word t votes for diagonal p - t: words of one quotation
share a diagonal, and an inserted or missing word moves it a little. Votes are gathered by
diagonal; neighbouring diagonals are merged; a merged span counts if enough of its
template's different grams voted. A name stands at a diagonal if all of its grams voted there.

Templates are whole texts of any length, notices and names (license_texts). Their grams are
broadcast while they are at most `BROADCAST_GRAMS`, and shuffled beyond.

Only DataFrame expressions are used. Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing; lower-casing never moves a word's bounds.

Defined cases: a null or empty text has no words, no labels and score 0. Rows with the
same id and the same text each give the same row; rows with the same id and other
texts are told apart by a hash of the text. A template of one word is refused. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm import license_texts

#: Words from which on a template's grams have three words.
LONG = 5
#: Share of a template's grams that must have voted; one changed word in ten takes 0.27.
COVERAGE = 0.6
#: Diagonals at most this far from the next belong together.
NEAR = 3
#: Grams of templates that may be broadcast.
BROADCAST_GRAMS = 200_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # found only whole
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        found = _WORD.findall(self.text.translate(_LOWER))
        if len(found) < 2:
            raise ValueError("a template has two words at least")
        return found

    def grams(self) -> list[tuple[int, str, str, str | None]]:
        w = self.words
        n = 3 if len(w) >= LONG else 2
        return [(k, w[k], w[k + 1], w[k + 2] if n == 3 else None) for k in range(len(w) - n + 1)]


TEMPLATES = (
    *(Template(label, text, exact=True, base=True) for label, text in license_texts.BASE),
    *(Template(label, text, exact=True) for label, text in license_texts.NAMES),
    *(Template(label, text) for label, text in (*license_texts.NOTICES, *license_texts.TEXTS)),
)

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """template, t, a, b, c, n_grams, exact and gram (the hash of a and b)."""
    quoted = lambda x: "CAST(NULL AS STRING)" if x is None else f"'{x}'"  # noqa: E731  words have no quotes or backslashes
    rows = ", ".join(f"({n}, {k}, '{a}', '{b}', {quoted(c)}, {len(t.grams())}, {str(t.exact).upper()})" for n, t in enumerate(templates) for k, a, b, c in t.grams())
    known = spark.sql(f"SELECT *, xxhash64(a, b) AS gram FROM VALUES {rows or "(0, 0, '', '', CAST(NULL AS STRING), 1, TRUE)"} AS known(template, t, a, b, c, n_grams, exact)")
    return known if templates else known.limit(0)


def votes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, text hash, template, n_grams, exact, diagonal, and the template positions that voted for it."""
    lowered = F.lower(_text(text))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(_text(text)).alias("text_hash"), _words(lowered).alias("w"))
    w = F.col("w")
    grams = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(F.size(w), F.lit(1))).alias("c"))
    # A filter by the number of words would be pushed below the split and make the words twice; of one word there is no second one to join.
    placed = rows.select("doc_id", "text_hash", F.posexplode(grams).alias("p", "g")).select("doc_id", "text_hash", "p", F.col("g")["a"].alias("wa"), F.col("g")["b"].alias("wb"), F.col("g")["c"].alias("wc"))
    known = template_grams(documents.sparkSession, templates)
    same = (F.xxhash64("wa", "wb") == F.col("gram")) & (F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b")) & (F.col("c").isNull() | (F.col("wc") == F.col("c")))
    met = placed.join(F.broadcast(known) if sum(len(t.grams()) for t in templates) <= BROADCAST_GRAMS else known.hint("merge"), same)
    return met.groupBy("doc_id", "text_hash", "template", "n_grams", "exact", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("voted"))


def spans(voted: DataFrame, near: int = NEAR, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans: doc_id, text_hash, template, start (word), coverage."""
    one = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(one) > F.when(F.col("exact"), 0).otherwise(near)).cast("int")
    runs = voted.withColumn("apart", apart).withColumn("run", F.sum(F.coalesce("apart", F.lit(0))).over(one))
    # As many positions as the run's votes, which are words of one text.
    merged = runs.groupBy("doc_id", "text_hash", "template", "n_grams", "exact", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("n"), F.min("diagonal").alias("start"))
    merged = merged.withColumn("coverage", F.col("n") / F.col("n_grams")).filter(F.col("coverage") >= F.when(F.col("exact"), 1.0).otherwise(coverage))
    return merged.select("doc_id", "text_hash", "template", F.greatest("start", F.lit(0)).alias("start"), "coverage")


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row a document: words, places of base phrases, labels and score."""
    found = spans(votes(documents, doc_id, text, templates))
    label = F.element_at(F.lit([t.label for t in templates] or [""]), F.col("template") + 1)
    base = F.element_at(F.lit([t.base for t in templates] or [False]), F.col("template") + 1)
    found = found.withColumns({"label": label, "base": base}).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(_text(text)).alias("text_hash"), F.size(_words(_text(text))).cast("long").alias("n_words"))
    f = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    joined = rows.join(f, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _grams_sql() -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    rows = [f"({n}, '{t.label}', {str(t.base).upper()}, {str(t.exact).upper()}, {len(t.grams())}, {k}, '{a}', '{b}', {quoted(c)})" for n, t in enumerate(TEMPLATES) for k, a, b, c in t.grams()]
    return ", ".join(rows)


ORACLE_SQL = rf"""
WITH known(template, label, base, exact, n_grams, t, a, b, c) AS (VALUES {_grams_sql()}),
doc AS (
  SELECT row_number() OVER () AS row, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS n_words,
    regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
gram AS (SELECT row, p - 1 AS p, w[p] AS wa, w[p + 1] AS wb, w[p + 2] AS wc FROM doc, unnest(range(1, len(w))) AS u(p)),
vote AS (SELECT row, template, label, base, exact, n_grams, p - t AS diagonal, t FROM gram JOIN known ON wa = a AND wb = b AND (c IS NULL OR c = wc)),
apart AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > CASE WHEN exact THEN 0 ELSE {NEAR} END, FALSE)::INT AS far
  FROM (SELECT DISTINCT row, template, exact, diagonal FROM vote)),
run AS (SELECT row, template, diagonal, sum(far) OVER (PARTITION BY row, template ORDER BY diagonal) AS run FROM apart),
span AS (
  SELECT row, label, base, greatest(min(diagonal), 0) AS start, count(DISTINCT t)::DOUBLE / n_grams AS coverage FROM vote JOIN run USING (row, template, diagonal)
  GROUP BY row, template, label, base, exact, n_grams, run HAVING count(DISTINCT t)::DOUBLE / n_grams >= CASE WHEN exact THEN 1 ELSE {COVERAGE} END),
found AS (
  SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score
  FROM span GROUP BY row)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM doc LEFT JOIN found USING (row)
"""
