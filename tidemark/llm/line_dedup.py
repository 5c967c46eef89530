"""Substring deduplication by lines and sentences: the earliest occurrence stays, later ones go.

A unit is a line that has a word, or a sentence within a line of several; sentences end at
. ! or ? before white space. Units are normalised (A-Z to a-z, white space runs to one
space, none at the ends) and hashed to 128 bits; digests are grouped over all documents,
so lines and sentences meet each other. The first unit with a digest, by document id and
then by place, stays. Of the later ones go

* lines, whatever their length;
* sentences next to each other that have `run_words` words together, with the white space
  up to the next one; shorter runs recur by chance and stay. A line of which nothing but
  white space is left goes with them.

Each removed span keeps its line number and its offsets in the original. Units next to
each other that other documents have too, the kept occurrence included, are a passage;
the longest one's words tell whether a document shares a passage, and which copy is kept
doesn't matter for that. A passage that begins and ends inside sentences loses these, so a
document is `repeated` from 40 words on to catch passages of 50.

1. Units are written once as a table; counts and the smallest and largest document id of a
   digest are combined before their shuffle, so a digest of many units is a row a task.
2. Units join the digests that occur twice or more. Both sides are tables, so Spark splits
   the partition of a digest that holds much of the corpus.
3. A document's marked units are gathered and join its text, which is cut.

Defined cases: a null or empty text has one empty line, which stays, and gives an empty
text; a null id ranks after all others. Rows with the same id are one document: a unit
that it has first stays in each of its rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import shared

#: Words of neighbouring repeated sentences that are removed; fewer recur by chance.
RUN_WORDS = 8
#: Words of a passage that makes a document a repeated one.
PASSAGE_WORDS = 40
_LAST = (1 << 63) - 1
_SPACE = "\x20\x09-\x0d"
_STOP = re.compile(rf"[.!?]+[{_SPACE}]+")
_UNITS = "rank long, of_text long, d1 long, d2 long, line int, start int, end int, words int, whole boolean, first boolean"
_OUT = "doc_id long, n_lines long, n_removed long, n_passage long, repeated boolean, removed array<struct<line:int,start:bigint,end:bigint>>, text string"
_KINDS = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.bool_()] * 2


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _sentences(line: str) -> list[tuple[int, int]]:
    """Where each sentence of a line begins, and where the next one does."""
    edges = [0, *(m.end() for m in _STOP.finditer(line)), len(line)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:]) if a < b]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that have a word, and their sentences if these are several."""
    names = [c.split()[0] for c in _UNITS.split(", ")]
    rows: list[tuple] = []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=names)

    for batch in batches:
        for rank, of_text, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            at, seen = 0, set()
            for k, line in enumerate(text.split("\n")):
                parts = _sentences(line)
                for n, (a, b) in enumerate([(0, len(line)), *(parts if len(parts) > 1 else [])]):
                    words = line[a:b].encode("utf-8", "replace").lower().split()
                    if words:
                        d = xxhash.xxh3_128_intdigest(b" ".join(words))
                        rows.append((rank, of_text, _signed(d >> 64), _signed(d & 0xFFFFFFFFFFFFFFFF), k, at + a, at + b, len(words), n == 0, d not in seen))
                        seen.add(d)
                at += len(line) + 1
            if len(rows) > 20_000:
                yield packed()
                rows = []
    if rows:
        yield packed()
    shared.release()


def _runs(text: str, units: list[dict]) -> list[list[dict]]:
    """Units next to each other: only white space is between them. A line stands for its sentences."""
    whole = {u["line"] for u in units if u["whole"]}
    runs: list[list[dict]] = []
    for u in sorted(units, key=lambda u: (u["start"], u["end"])):
        if u["line"] in whole and not u["whole"]:
            continue
        if runs and not text[runs[-1][-1]["end"] : u["start"]].strip(" \t\n\v\f\r"):
            runs[-1].append(u)
        else:
            runs.append([u])
    return runs


def _cut(text: str, units: list[dict], run_words: int) -> tuple[list[dict], int, str]:
    """Removed spans in order, words of the longest passage, and what is left of the text."""
    passage = max((sum(u["words"] for u in run) for run in _runs(text, [u for u in units if u["elsewhere"]])), default=0)
    gone: dict[int, list[tuple[int, int]]] = {}
    for run in _runs(text, [u for u in units if u["gone"]]):
        long = sum(u["words"] for u in run) >= run_words
        for u in run:
            if u["whole"] or long:
                gone.setdefault(u["line"], []).append((u["start"], u["end"]))
    if not gone:
        return [], passage, text
    removed, left, at = [], [], 0
    for k, line in enumerate(text.split("\n")):
        spans, kept, last = gone.get(k, []), [], at
        for a, b in spans:
            kept.append(text[last:a])
            last = b
        kept.append(text[last : at + len(line)])
        rest = "".join(kept)
        if not spans or rest.strip(" \t\v\f\r"):
            left.append(rest)
        removed += [{"line": k, "start": a, "end": b} for a, b in spans]
        at += len(line) + 1
    return removed, passage, "\n".join(left)


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed (spans), n_passage, repeated, removed: array<struct<line, start, end>> (code points), text."""
    shared.bounded_batches(documents.sparkSession)
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("rank"), F.xxhash64(value).alias("of_text"), value.alias("text"))
    units, _ = shared.written(docs.select("rank", "of_text", "text").mapInArrow(_units, _UNITS), "units")
    again = units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("rank").alias("keeper"), F.max("rank").alias("last")).filter("n > 1")
    again, _ = shared.written(again.select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), "keeper", "last"), "digests")
    marked = units.join(again, (F.col("d1") == F.col("x1")) & (F.col("d2") == F.col("x2")))
    marked = marked.withColumns({"gone": ~((F.col("rank") == F.col("keeper")) & F.col("first")), "elsewhere": F.col("keeper") < F.col("last")})
    # A set, for rows that are repeated whole.
    found = marked.groupBy(F.col("rank").alias("cut_rank"), F.col("of_text").alias("cut_text")).agg(F.collect_set(F.struct("line", "start", "end", "words", "whole", "gone", "elsewhere")).alias("units"))
    found, _ = shared.written(found, "cuts")
    rows = docs.join(found, (F.col("rank") == F.col("cut_rank")) & (F.col("of_text") == F.col("cut_text")), "left").select("doc_id", "text", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = [_cut(t, u, run_words) if u else ([], 0, t) for t, u in zip(texts, batch.column(2).to_pylist())]
            passage = [d[1] for d in done]
            spans = pa.array([d[0] for d in done], pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))
            columns = [batch.column(0), pa.array([t.count("\n") + 1 for t in texts], pa.int64()), pa.array([len(d[0]) for d in done], pa.int64()), pa.array(passage, pa.int64()), pa.array([p >= passage_words for p in passage], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, spans, pa.array([d[2] for d in done], pa.string())], names=[c.split()[0] for c in _OUT.split(", ")])
        shared.release()

    return rows.mapInArrow(run, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumn("removed", F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["line"], r["start"], r["end"])), ","))


def _runs_sql(marked: str, island: str) -> str:
    """Pieces of each document, where a line with the mark is one and other lines are as many as their sentences; `island` counts the unmarked ones before."""
    return f"""
  SELECT *, count(*) FILTER (NOT {marked}) OVER (PARTITION BY doc_id ORDER BY line, start ROWS UNBOUNDED PRECEDING) AS {island} FROM (
    SELECT u.* FROM unit u JOIN wholes w USING (doc_id, line) WHERE CASE WHEN w.{marked} OR w.n_parts = 1 THEN u.whole ELSE NOT u.whole END)"""


#: For tables without repeated ids.
ORACLE_SQL = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, k - 1 AS line, ls[k] AS t, coalesce(list_sum(list_transform(ls[1 : k - 1], lambda x: length(x) + 1)), 0)::BIGINT AS base
  FROM split, unnest(range(1, len(ls) + 1)) AS u(k)),
parted AS (SELECT *, list_filter(regexp_extract_all(t, '(?s).*?(?:[.!?]+[{_SPACE}]+|$)'), lambda x: x <> '') AS parts FROM lines),
piece AS (
  SELECT doc_id, line, TRUE AS whole, base AS start, base + length(t) AS stop, t AS x, len(parts) AS n_parts FROM parted
  UNION ALL
  SELECT doc_id, line, FALSE, base + coalesce(list_sum(list_transform(parts[1 : k - 1], lambda x: length(x))), 0)::BIGINT,
    base + list_sum(list_transform(parts[1 : k], lambda x: length(x)))::BIGINT, parts[k], len(parts)
  FROM parted, unnest(range(1, len(parts) + 1)) AS u(k) WHERE len(parts) > 1),
norm AS (
  SELECT * EXCLUDE (x), list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_SPACE}]+'), lambda y: y <> '') AS w FROM piece),
keyed AS (SELECT * EXCLUDE (w), len(w) AS words, array_to_string(w, ' ') AS key FROM norm WHERE len(w) > 0),
unit AS (
  SELECT * EXCLUDE (key), row_number() OVER (PARTITION BY key ORDER BY doc_id, line, whole DESC, start) > 1 AS gone,
    min(doc_id) OVER (PARTITION BY key) < max(doc_id) OVER (PARTITION BY key) AS elsewhere
  FROM keyed),
wholes AS (SELECT doc_id, line, gone, elsewhere, n_parts FROM unit WHERE whole),
removal AS ({_runs_sql("gone", "island")}),
passage AS ({_runs_sql("elsewhere", "island")}),
longest AS (SELECT doc_id, max(n) AS n_passage FROM (SELECT doc_id, sum(words) AS n FROM passage WHERE elsewhere GROUP BY doc_id, island) GROUP BY doc_id),
cut AS (
  SELECT *, gone AND (whole OR sum(words) FILTER (gone) OVER (PARTITION BY doc_id, island) >= {RUN_WORDS}) AS away FROM removal),
gaps AS (SELECT doc_id, count(*) AS n, string_agg(concat(line, ':', start, ':', stop), ',' ORDER BY line, start) AS removed FROM cut WHERE away GROUP BY doc_id),
rest AS (
  SELECT l.doc_id, l.line, l.t, string_agg(substring(l.t, (c.start - l.base + 1)::BIGINT, (c.stop - c.start)::BIGINT), '' ORDER BY c.start) FILTER (NOT c.away) AS stay, coalesce(bool_or(c.away), FALSE) AS touched
  FROM lines l LEFT JOIN cut c USING (doc_id, line) GROUP BY l.doc_id, l.line, l.t),
left_over AS (
  SELECT doc_id, string_agg(CASE WHEN touched THEN stay ELSE t END, chr(10) ORDER BY line) FILTER (NOT touched OR regexp_matches(coalesce(stay, ''), '[^{_SPACE}]')) AS text
  FROM rest GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(n_passage, 0)::BIGINT AS n_passage,
  coalesce(n_passage, 0) >= {PASSAGE_WORDS} AS repeated, coalesce(removed, '') AS removed, coalesce(o.text, '') AS text
FROM split s LEFT JOIN gaps USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN left_over o USING (doc_id)
"""
