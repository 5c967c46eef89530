"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `window` consecutive words of an item, or the whole item if it has fewer
words, but one at least. A window must be contained whole, so any one of its shingles
is a sufficient prefix for the join: the rarest one in the corpus is taken, which
keeps the number of candidates least. The steps:

1. items become windows, and windows their shingles of `shingle` words (all words of a
   shorter window), as tables;
2. a pass over all documents counts their shingles, combined per task, which are joined
   with the windows': that is a shingle's rarity;
3. of each window's shingles, in the order of rarity, the first is kept with its offset;
4. a second pass lists the places of those prefix tokens in the documents, with the words
   around; they are joined with the prefixes by shingle. A match at word p of a token at
   offset o proposes the window at p - o, bounded by the document's first and last word;
5. the window's words must stand there, compared as strings.

In both passes a bitmap of the wanted shingles' hashes, of bounded size, keeps most other
shingles of the documents out of the joins; what it lets through by chance finds no
partner. It is all of the items that the driver holds. Texts are never shuffled.

Defined cases: a null or empty text has no words, is never hit and gives no window;
an item with equal words elsewhere is found wherever any item's window stands;
repeated document rows give a row each; repeated item ids count once for a document.
An item whose id is null hits words as any other does, and is left out of the ids only.
Documents with one id and different texts are told apart by a hash of the text. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import shared, textbuf as tb

WINDOW = 10
SHINGLE = 3
#: The bitmap has 64 bits for each wanted shingle, and 2^SIEVE_BITS bits at most.
SIEVE_BITS = 27
#: Rows of windows, prefixes or ids that may be broadcast.
BROADCAST_ROWS = 500_000

_FOUND = "doc_id long, of_text long, n_words long, met array<struct<g: long, size: int, left: int, start: int, words: string>>"


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, tb.Words, np.ndarray]]:
    for lo, hi, data, offsets in tb.groups(batch.column(at)):
        w = tb.words(data, offsets, tb.ALNUM_WORD)
        yield lo, hi, w, w.hashes()


def _joined(w: tb.Words, a: int, b: int) -> str:
    return b" ".join(w.text(k) for k in range(a, b)).decode()


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item, win (its words, one space apart) of (item, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, _ in _texts(batch, 1):
                for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    words = [w.text(x).decode() for x in range(a, b)]
                    n = min(size, b - a)
                    found = list({" ".join(words[x : x + n]) for x in range(b - a - n + 1)}) if n else []
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[lo + k].as_py()] * len(found), pa.string()), pa.array(found, pa.string())], names=["item", "win"])

    return items.mapInArrow(cut, "item string, win string").distinct()


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """win, size (words of the shingle), g (its hash), offset of (win)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, w, h in _texts(batch, 0):
                for size in range(1, shingle + 1):
                    at = np.flatnonzero(w.counts == size if size < shingle else w.counts >= size)
                    if len(at):
                        n = w.counts[at] - size + 1
                        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        of = np.repeat(at, n)
                        g = tb.rolling(h, size)[w.first[of] + offset].view(np.int64)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + lo)), pa.array(np.full(len(of), size, np.int32)), pa.array(g), pa.array(offset.astype(np.int32))], names=["win", "size", "g", "offset"])

    return windows.mapInArrow(cut, "win string, size int, g long, offset int")


class Sieve:
    """Which hashes may be wanted, by a bitmap of their first bits; and the sizes of the shingles."""

    def __init__(self, bits: int, sizes: list[int], words: np.ndarray):
        self.bits, self.sizes, self.words = bits, sizes, words

    def find(self, g: np.ndarray) -> np.ndarray:
        at = (g >> np.uint64(64 - self.bits)).astype(np.int64)
        return np.flatnonzero((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))


def sieve_of(wanted: DataFrame) -> Sieve:
    """The sieve of (size, g); the bitmap is put together in Spark, in words of 64 bits."""
    few = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bits = max(12, min(SIEVE_BITS, (64 * sum(few.values())).bit_length()))
    place = wanted.select(F.shiftrightunsigned("g", 64 - bits).alias("at"))
    rows = place.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    words = np.zeros(1 << (bits - 6), np.int64)
    found = rows.toArrow()  # at most 2^(SIEVE_BITS - 6) rows
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Sieve(bits, sorted(few), words.view(np.uint64))


def _counted(texts: DataFrame, sieve) -> DataFrame:
    """size, g, n: how often shingles that the sieve lets through occur in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in sieve.value.sizes}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                if parts:
                    g, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(g)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], names=["size", "g", "n"])
                    held[k] = []

        for batch in batches:
            for _, _, w, h in _texts(batch, 0):
                for k in sieve.value.sizes:
                    g = tb.rolling(h, k)
                    g = g[tb.inside_documents(w.first, k, len(g))]
                    held[k].append(np.unique(g[sieve.value.find(g)], return_counts=True))
                    size += len(held[k][-1][0])
            if size > 500_000:
                yield from told()
                size = 0
        yield from told()
        shared.release()

    return texts.mapInArrow(count, "size int, g long, n long").groupBy("size", "g").agg(F.sum("n").alias("n"))


def prefixes_of(shingles: DataFrame, counted: DataFrame) -> DataFrame:
    """win, n_win, size, g, offset: the rarest shingle of each window; of equals the first."""
    rare = shingles.join(counted.select(F.col("size").alias("s"), F.col("g").alias("h"), "n"), (F.col("size") == F.col("s")) & (F.col("g") == F.col("h")), "left")
    first = rare.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "size", "g")).alias("p"))
    return first.select("win", F.size(F.split("win", " ")).alias("n_win"), F.col("p.size").alias("of_size"), F.col("p.g").alias("of_g"), F.col("p.offset").alias("offset"))


def _search(docs: DataFrame, sieve, window: int) -> DataFrame:
    """A row a document: its number of words, and the places of shingles that the sieve lets through, with the words around."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, h in _texts(batch, 2):
                at, size, grams = [], [], []
                for k in sieve.value.sizes:
                    g = tb.rolling(h, k)
                    p = sieve.value.find(g)
                    p = p[tb.inside_documents(w.first, k, len(g))[p]]
                    at.append(p)
                    size.append(np.full(len(p), k))
                    grams.append(g[p])
                at, size, grams = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in ((np.int64, at), (np.int64, size), (np.uint64, grams)))
                order = np.argsort(at, kind="stable")
                at, size, grams = at[order], size[order], grams[order]
                doc = np.searchsorted(w.first, at, "right") - 1
                a, b = np.maximum(w.first[doc], at - window + 1), np.minimum(w.first[doc + 1], at + window)
                around = [_joined(w, x, y) for x, y in zip(a.tolist(), b.tolist())]
                met = pa.StructArray.from_arrays([pa.array(grams.view(np.int64)), pa.array(size.astype(np.int32)), pa.array((at - a).astype(np.int32)), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(around, pa.string())], names=["g", "size", "left", "start", "words"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)), met)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(w.counts.astype(np.int64)), lists], names=["doc_id", "of_text", "n_words", "met"])
        shared.release()

    return docs.mapInArrow(find, _FOUND)


def _maybe_broadcast(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def hits(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """doc_id, of_text, start, n_win, win of every occurrence of a window; of the rows of _search."""
    met = found.select("doc_id", "of_text", F.explode("met").alias("m")).select("doc_id", "of_text", "m.*")
    both = met.join(_maybe_broadcast(prefixes), (F.col("size") == F.col("of_size")) & (F.col("g") == F.col("of_g")))
    around = F.split("words", " ")
    skip = F.col("left") - F.col("offset")
    fits = (skip >= 0) & (F.size(around) - skip >= F.col("n_win"))
    stands = F.array_join(F.slice(around, skip + 1, F.col("n_win")), " ") == F.col("win")
    return both.filter(F.when(fits, stands).otherwise(False)).select("doc_id", "of_text", (F.col("start") - F.col("offset")).alias("start"), "n_win", "win")


def contaminated(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the sorted item ids, and of_text (the text's hash)."""
    spark = documents.sparkSession
    shared.bounded_batches(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_text).cast("string")).alias("of_text"), F.col(doc_text).cast("string").alias("text"))
    owned, _ = shared.written(windows_of(items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")), window), "windows")
    pieces, _ = shared.written(shingles_of(owned.select("win").distinct(), shingle), "shingles")
    broadcast = spark.sparkContext.broadcast
    wanted = broadcast(sieve_of(pieces.select("size", "g").distinct()))
    prefixes, _ = shared.written(prefixes_of(pieces, _counted(docs.select("text"), wanted)), "prefixes")
    tokens = broadcast(sieve_of(prefixes.select(F.col("of_size").alias("size"), F.col("of_g").alias("g")).distinct()))
    found, _ = shared.written(_search(docs, tokens, window), "places")
    wanted.unpersist()
    tokens.unpersist()

    hit, _ = shared.written(hits(found, prefixes).distinct(), "hits")
    spans = F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n_win")).alias("b"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate("spans", none, lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], x["to"]))).alias("n"), F.greatest(x["to"], s["b"]).alias("to")), lambda x: x["n"])
    key = ["doc_id", "of_text"]
    counts = hit.groupBy(key).agg(spans.alias("spans")).select(*key, covered.cast("long").alias("n_hit"))
    owners = owned.select(F.col("win").alias("of_win"), "item")
    named = hit.select(*key, "win").distinct().join(_maybe_broadcast(owners), F.col("win") == F.col("of_win")).groupBy(key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = lambda a, b: [F.col(c).eqNullSafe(F.col(f"{b}_{c}")) for c in key]
    renamed = lambda t, b: t.select(*[F.col(c).alias(f"{b}_{c}") for c in key], *[c for c in t.columns if c not in key])
    told, _ = shared.written(counts.join(renamed(named, "i"), same("", "i")).select(*key, "n_hit", "items"), "told")
    rows = found.select(*key, "n_words").join(_maybe_broadcast(renamed(told, "t")), same("", "t"), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ids.alias("items"), "of_text")


def clean(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **options) -> DataFrame:
    """The documents without any window of an item, with all their columns."""
    judged = contaminated(documents, items, doc_id, doc_text, **options)
    gone, _ = shared.written(judged.filter("contaminated").select(F.col("doc_id").alias("_gone"), F.col("of_text").alias("_text")).distinct(), "gone")
    return documents.join(_maybe_broadcast(gone), F.col(doc_id).cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col(doc_text).cast("string")) == F.col("_text")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.drop("items", "of_text")


#: A window is a list of words; each document's windows of every length that items have are joined with them.
ORACLE_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(k) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
hits AS (SELECT a.r, a.k, a.n, v.item FROM spots a JOIN wins v ON a.n = v.n AND a.win = v.win),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(j) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS items FROM hits WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
