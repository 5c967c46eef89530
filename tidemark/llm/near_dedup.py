"""MinHash near-deduplication with odd sketches and links confirmed on full sets.

A text's set is its distinct shingles of five words. Documents with 100 * |A & B| >=
75 * |A | B| are linked; components of the links are the groups of copies.

1. One pass over the texts gives each document its set's size and 128-bit digest,
   MinHash samples cut into bands, and an odd sketch: a bitmap in which each (sample
   number, sample) pair flips one bit, so the population count of two sketches' XOR
   estimates how many samples differ.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Classes that share a band meet their band's most central member, the original of a
   group of copies if it is there. The sketches drop
   pairs far below the threshold. For each class the closest such pair is confirmed
   first; other pairs only where they still join different components.
4. In bands whose members are yet in different components, members of one component
   meet members of others; a band of more than a block is written in blocks, whose pairs
   are read, so a member is never copied. A pair is taken up in the first band that it shares. Shingles that no other of these texts has bound a pair's
   similarity from above, and a sketch of 1024 samples estimates it finely; what passes
   both is confirmed. A band of copies that step 3 has joined is never paired.
5. Confirmation compares the whole shingle sets, recomputed from the texts of the
   classes concerned.

A link is lost only if two texts with similarity 0.75 or more share none of 24 bands of
3 samples (2e-6 at 0.75, less above) or a sketch lies 5.5 standard deviations off (2e-8).

Defined cases: a text with fewer than five words, but one, has one shingle, the whole
sequence; a null or empty text has none, is linked with nothing and kept. A null id is
linked with nothing, kept, and has a null component. Rows with the same id are one
node: each gives a row, with its own set size and the node's component. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import shared, textbuf as tb
from tidemark.llm.components import components
from tidemark.storage import small

SHINGLE = 5
BANDS, ROWS = 24, 3
SKETCH_WORDS = 8
#: Bits in which two sketches may differ: at similarity 0.75 it is 34 of 512 on average (deviation 6.7).
MOST_BITS = 72
#: The finer sketch of step 4; at similarity 0.75 it differs in 481 of 8192 bits on average (deviation 25).
FINE_SAMPLES, FINE_WORDS, FINE_BITS = 1024, 128, 620
#: Members of a block in step 4, of about 1.3 kB each.
BLOCK = 4096
#: As many ids may be broadcast; beyond that the same join is shuffled.
BROADCAST_IDS = 1_000_000

_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, (2, FINE_SAMPLES), dtype=np.uint64)


def _sets(w: tb.Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    h = w.hashes()
    grams = tb.rolling(h, size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield tb.rolling(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield h[:0]


def _minima(every: np.ndarray, begin: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples of the sets that begin at `begin` in one array: a row a set."""
    return np.stack([np.minimum.reduceat(every * (_SEEDS[0, k] | np.uint64(1)) + _SEEDS[1, k], begin) for k in range(samples)], axis=1)


def _odd_sketch(least: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmaps of `size` words: each (sample number, sample) flips one bit."""
    number = np.arange(least.shape[1], dtype=np.uint64)
    place = tb.mix(least + number * tb._STEP) % np.uint64(64 * size)
    sketch, rows = np.zeros((len(least), size), np.uint64), np.arange(len(least))
    for k in range(least.shape[1]):
        sketch[rows, (place[:, k] // np.uint64(64)).astype(np.int64)] ^= np.uint64(1) << (place[:, k] % np.uint64(64))
    return sketch


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    odd = _SEEDS[0, 0] | np.uint64(1)
    for batch in batches:
        for lo, hi, data, offsets in tb.groups(batch.column(1)):
            sets = list(_sets(tb.words(data, offsets, tb.BLANK_WORD), size))
            n = np.array([len(s) for s in sets])
            some = np.flatnonzero(n)
            sketch = np.zeros((hi - lo, SKETCH_WORDS), np.uint64)
            bands = np.zeros((hi - lo, BANDS), np.uint64)
            digest = np.zeros((hi - lo, 2), np.uint64)
            if len(some):
                every = np.concatenate([sets[k] for k in some])
                begin = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                digest[some, 0] = np.add.reduceat(tb.mix(every), begin)
                digest[some, 1] = np.bitwise_xor.reduceat(tb.mix(every * odd), begin)
                least = _minima(every, begin, BANDS * ROWS)
                sketch[some] = _odd_sketch(least, SKETCH_WORDS)
                for b in range(BANDS):
                    key = np.full(len(some), b, np.uint64)
                    for r in range(ROWS):
                        key = tb.mix(key * tb._STEP + least[:, b * ROWS + r])
                    bands[some, b] = key
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), _lists(sketch), _lists(bands)], names=["doc_id", "n_shingles", "d1", "d2", "sketch", "bands"])
    shared.release()


def signatures(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), sketch, bands; of (doc_id, text)."""
    return documents.mapInArrow(lambda b: _signatures(b, size), "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>, bands array<long>")


def _differing(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _set_table(ids: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """(id, shingles): the whole shingle sets of the documents with these ids, from their texts.

    A bounded number of ids is broadcast; more are joined by a shuffle.
    """
    held, _ = shared.written(ids, "ids")
    small = held.count() <= BROADCAST_IDS
    texts = documents.join(F.broadcast(held) if small else held.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.groups(batch.column(1)):
                found = [s.tobytes() for s in _sets(tb.words(data, offsets, tb.BLANK_WORD), size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, pa.binary())], names=["id", "shingles"])

    return shared.written(texts.mapInArrow(sets, "id long, shingles binary"), "sets")[0]


def _confirm(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = table.select(F.col("id").alias("ia"), F.col("shingles").alias("sa")), table.select(F.col("id").alias("ib"), F.col("shingles").alias("sb"))
    both = pairs.join(left.hint("merge"), F.col("a") == F.col("ia")).join(right.hint("merge"), F.col("b") == F.col("ib"))
    return shared.written(both.select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long").distinct(), "confirmed")[0]


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b")).distinct().toDF("id")


def _bounds(table: DataFrame) -> DataFrame:
    """id, n (shingles), common (those that another set of the table has too) and a fine odd sketch, of a table of sets."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        step = 256
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
            yield part.column(0).to_numpy(), sets, np.array([len(s) for s in sets])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets, n in read(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "shingle"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets, n in read(batch):
                begin = np.concatenate([[0], np.cumsum(n)[:-1]])
                fine = _odd_sketch(_minima(np.concatenate(sets), begin, FINE_SAMPLES), FINE_WORDS)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), _lists(fine)], names=["id", "n", "fine"])

    able = table.filter(F.octet_length("shingles") > 0)
    by_shingle = able.mapInArrow(shingles, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("id").alias("own_id"))
    alone = by_shingle.filter("k = 1").groupBy("own_id").agg(F.count("*").alias("alone"))
    fine = able.mapInArrow(sketches, "id long, n long, fine array<long>")
    return shared.written(fine.join(alone, F.col("id") == F.col("own_id"), "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"), "fine"), "bounds")[0]


def _with_component(rows: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    c = comps.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(c, F.col(node) == F.col("_n"), "left").withColumn(name, F.coalesce("_c", F.col(node))).drop("_n", "_c")


@dataclass
class Block:
    """Members of one band and kind."""

    id: np.ndarray
    component: np.ndarray
    n: np.ndarray
    common: np.ndarray
    fine: np.ndarray
    bands: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Block:
        wide = lambda name: t[name].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(t), -1)
        return cls(*(t[c].to_numpy() for c in ("id", "component", "n", "common")), wide("fine"), wide("bands"))

    def publish(self, folder: str, name: str) -> None:
        shared.publish(folder, name, np.array([len(self.id)]), self.id, self.component, self.n, self.common, self.fine, self.bands)

    @classmethod
    def read(cls, folder: str, name: str) -> Block:
        raw = shared.mapped(folder, name).view(np.int64)
        k = int(raw[0])
        ids, component, n, common = raw[1 : 1 + 4 * k].reshape(4, k)
        fine, bands = np.split(raw[1 + 4 * k :].view(np.uint64), [FINE_WORDS * k])
        return cls(ids, component, n, common, fine.reshape(k, FINE_WORDS), bands.reshape(k, BANDS))


def _compared(left: Block, right: Block, band: int, same: bool, most_bits: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a member of `left` and one of `right` in other components whose sketches are near enough; each pair once if the two are the same.

    A pair's intersection is at most the smaller count of common shingles, which bounds its similarity.
    """
    here = np.array([band], np.int64).view(np.uint64)[0]
    # A sixteenth of the sketch rules out most pairs; at similarity 0.75 it differs in 30 bits on average (deviation 5.3).
    begin = np.ascontiguousarray(right.fine[:, :SKETCH_WORDS])
    for k in range(len(left.id)):
        both = np.minimum(right.common, left.common[k])
        near = np.flatnonzero((right.component != left.component[k]) & (100 * both >= percent * (right.n + left.n[k] - both)))
        if same:
            near = near[right.id[near] > left.id[k]]
        near = near[np.bitwise_count(begin[near] ^ left.fine[k, :SKETCH_WORDS]).sum(axis=1) <= MOST_BITS]
        near = near[np.bitwise_count(right.fine[near] ^ left.fine[k]).sum(axis=1) <= most_bits]
        shared_bands = right.bands[near] == left.bands[k]
        near = near[left.bands[k][np.argmax(shared_bands, axis=1)] == here]  # the first band that the two share
        if len(near):
            a = np.full(len(near), left.id[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, right.id[near])), pa.array(np.maximum(a, right.id[near]))], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal key, from rows in order of it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key)))
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and keys[a] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _met(rows: DataFrame, block: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (band, id, component, major, n, common, fine, bands) of a band to be confirmed.

    Members of the band's major component meet all others, and these each other. Bands of at most `block`
    members of either kind are compared where they are. Those of larger ones are written once, in blocks of
    about as many, and pairs of blocks are read: a member is never copied.
    """
    spark = rows.sparkSession
    rows, _ = shared.written(rows.withColumn("major", F.col("component") == F.col("major")), "members")
    sizes = rows.groupBy("band").agg(*[F.ceil(F.count(F.when(c, 1)) / block).cast("int").alias(name) for c, name in ((F.col("major"), "n_major"), (~F.col("major"), "n_minor"))]).filter("n_minor > 0")
    sizes, _ = shared.written(sizes, "sizes")
    rows = rows.join(small(sizes), "band")
    one = (F.col("n_major") <= 1) & (F.col("n_minor") <= 1)

    def compare_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band,), t in _groups(batches, ["band"]):
            major = t["major"].to_numpy()
            minor = Block.of(t.filter(pa.array(~major)))
            if major.any():
                yield from _compared(minor, Block.of(t.filter(pa.array(major))), band, False, FINE_BITS, percent)
            yield from _compared(minor, minor, band, True, FINE_BITS, percent)

    near = rows.filter(one).repartition("band").sortWithinPartitions("band").mapInArrow(compare_here, "a long, b long")
    if sizes.filter(~one).isEmpty():
        return near.distinct()

    folder = shared.fresh(spark, "blocks")
    name = lambda band, major, mine: f"{band & 0xFFFFFFFFFFFFFFFF:016x}-{int(major)}-{mine}"
    key = ["band", "major", "mine"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, major, mine), t in _groups(batches, key):
            Block.of(t).publish(folder, name(band, major, mine))
            yield pa.RecordBatch.from_arrays([pa.array([band], pa.int64()), pa.array([major], pa.bool_()), pa.array([mine], pa.int32())], names=key)
        shared.release()

    large = rows.filter(~one).withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("major"), F.col("n_major")).otherwise(F.col("n_minor"))).cast("int"))
    blocks, _ = shared.written(large.repartition(*key).sortWithinPartitions(*key).mapInArrow(write, "band long, major boolean, mine int"), "block-list")
    others = blocks.select(F.col("band").alias("of"), F.col("major").alias("to_major"), F.col("mine").alias("other"))
    pairs = blocks.filter("NOT major").join(others, (F.col("band") == F.col("of")) & (F.col("to_major") | (F.col("mine") <= F.col("other")))).select("band", "mine", "to_major", "other")

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, mine, to_major, other in zip(*(c.to_pylist() for c in batch.columns)):
                same = not to_major and mine == other
                yield from _compared(Block.read(folder, name(band, False, mine)), Block.read(folder, name(band, to_major, other)), band, same, FINE_BITS, percent)
        shared.release()

    return near.union(pairs.repartition("band", "mine", "to_major", "other").mapInArrow(compare_blocks, "a long, b long")).distinct()


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 75) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    shared.bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed, _ = shared.written(signatures(docs, size), "signatures")
    able = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes, _ = shared.written(able.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    same = [F.col(c) == F.col(f"c_{c}") for c in ("d1", "d2", "n_shingles")] + [F.col("doc_id") == F.col("id")]
    named = classes.select(*[F.col(c).alias(f"c_{c}") for c in ("d1", "d2", "n_shingles")], "id")
    first, _ = shared.written(able.join(named, same, "left_semi").select(F.col("doc_id").alias("id"), "sketch", "bands"), "first")

    # Rows with one id and different texts are one node: their classes are linked.
    digest = [F.col(c) == F.col(f"c_{c}") for c in ("d1", "d2", "n_shingles")]
    members_of_class, _ = shared.written(signed.join(named, [*digest, F.col("doc_id").isNotNull()], "left").select("doc_id", "n_shingles", "id"), "members")
    several = members_of_class.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select(F.col("doc_id").alias("d"), "a")
    repeated = members_of_class.join(several, F.col("doc_id") == F.col("d")).filter("a < id").select("a", F.col("id").alias("b")).distinct()

    # Each class meets the most central member of its band: the one whose bands have the most members in all.
    banded = first.select(F.explode("bands").alias("band"), "id")
    # Tables on both sides, so that Spark splits the partition of a band that holds much of the corpus.
    sizes, _ = shared.written(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    multi, _ = shared.written(banded.join(sizes, "band").select("band", "id", "n"), "bands")
    central = multi.groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = multi.join(central, "id")
    leaders, _ = shared.written(weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("id")))["id"].alias("leader")).select("band", (-F.col("leader")).alias("leader")), "leaders")
    shared_bands = multi.join(leaders, "band")
    stars = shared_bands.filter("id != leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"), "id").distinct()
    sa, sb = first.select(F.col("id").alias("ia"), F.col("sketch").alias("sa")), first.select(F.col("id").alias("ib"), F.col("sketch").alias("sb"))
    near = stars.join(sa, F.col("a") == F.col("ia")).join(sb, F.col("b") == F.col("ib")).withColumn("far", _differing("sa", "sb")).filter(F.col("far") <= MOST_BITS)
    near, _ = shared.written(near.select("a", "b", "far", "id"), "near")

    closest = near.groupBy("id").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = _confirm(closest, _set_table(_ends(closest), docs, size), percent).union(repeated)
    comps = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        both = _with_component(_with_component(pairs, comps, "a", "ca"), comps, "b", "cb")
        return both.filter("ca != cb").select("a", "b")

    others = apart(near.join(closest.select(F.col("a").alias("xa"), F.col("b").alias("xb")), (F.col("a") == F.col("xa")) & (F.col("b") == F.col("xb")), "left_anti").select("a", "b").distinct())
    others, _ = shared.written(others, "others")
    if not others.isEmpty():
        links = links.union(_confirm(others, _set_table(_ends(others), docs, size), percent))
        comps = components(links)

    # Bands of more than two members whose members are still apart.
    members = _with_component(multi.filter("n > 2").select("band", "id"), comps, "id", "component")
    split, _ = shared.written(members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("band"), "split")
    members, _ = shared.written(members.join(split, "band", "left_semi"), "apart")
    if not members.isEmpty():
        table = _set_table(members.select("id").distinct(), docs, size)
        # |A & B| is at most the common shingles of A, and |A | B| at least |A|.
        able = _bounds(table).filter(F.col("common") * 100 >= percent * F.col("n"))
        rows = members.join(able, "id").join(first.select("id", "bands"), "id").join(leaders, "band")
        met = _met(_with_component(rows, comps, "leader", "major"), BLOCK, percent)
        tried = near.select(F.col("a").alias("xa"), F.col("b").alias("xb")).distinct()
        met, _ = shared.written(met.join(tried, (F.col("a") == F.col("xa")) & (F.col("b") == F.col("xb")), "left_anti"), "met")
        if not met.isEmpty():
            links = links.union(_confirm(met, table, percent))
            comps = components(links)

    rows = _with_component(members_of_class, comps, "id", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
