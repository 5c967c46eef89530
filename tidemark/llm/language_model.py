"""An interpolated modified Kneser-Ney model of any order, counted in Spark and memory-mapped by workers.

Tokens are the words of a text with A-Z lower-cased, then one end token, behind one start
mark. A gram is a token with the tokens before it, `order` in all, or fewer where it reaches
back to the start mark. Training takes these passes of shuffles:

1. word hashes are counted and written as sorted hash arrays, in shards by hash range;
   a word's place in them is its number;
2. grams, as columns of numbers packed and combined per task, are grouped by shards of
   their first token, summed, and written as contexts with their words and counts;
3. the different grams, without their first token, are those of the next lower order,
   which is written in the same way, down to bigrams;
4. each word's number of different contexts is summed over the shards and written beside
   the words: the lowest order of the model.

Grams that begin with a frequent token are dealt to several shards by the rest of them, as
many as its count takes, so no shard grows with one token; a context's sums are then the
sums over its shards. Rows of a shard are merged as they arrive. Within a shard, numbers
are stored by their two lower bytes and the rest, and the sizes of contexts by one byte.

Discounts of each order come from counts of counts. Scoring is a pass over the texts:
each worker memory-maps the shards it meets and binary-searches sorted queries in them,
so a worker's memory doesn't grow with the model. Shards hold a bounded number of
entries; their number grows with the corpus.

    p(w | uv) = max(c(uvw) - D, 0) / c(uv) + gamma(uv) * p(w | v)
    p(w)      = max(n(w) - D', 0) / sum n + gamma' / (V + 1)

with c the training count for grams of the full order and those that begin with the start
mark, and for others the number of different tokens before the gram; n(w) the number of
contexts of w; and D by count 1, 2, 3+. Contexts of up to two tokens are compared by their
numbers, longer ones by a 64-bit hash of them.

Defined cases: a null or empty text is the end token alone. A null id is in training.
An unknown word has the probability gamma' / (V + 1); an unknown context leaves that of
the next shorter one. Without training texts every token has probability 1. Rows with the
same id count and are scored each. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import shared, textbuf as tb

END = np.uint64(xxhash.xxh3_64_intdigest(b"tidemark end of text"))
#: The query's order.
ORDER = 3
#: Tokens of a shard of grams, about, and words of a shard of words.
SHARD, WORDS = 1_000_000, 250_000
#: Tokens whose grams are combined before they are sent, and distinct words of groups of texts.
COMBINE, COMBINE_WORDS = 1_500_000, 3_000_000
#: Shards of level k are numbered from k * SPAN; statistics travel below SPAN.
SPAN = 1 << 20
#: Sizes of contexts, a byte each, are summed from every STEP-th on: those before one are bytes of one number.
STEP = 8
#: Contexts with more words than this have their sums in the file; those of others are taken when they are met.
LONG = 8
GRAMS = "shard int, n long, g binary, c binary"
GROUP = 4 << 20


@dataclass(frozen=True)
class Model:
    """What a worker needs to find and read the model's files."""

    folder: str
    word_bits: int  # words are sharded by the first bits of their hash
    bases: tuple[int, ...]  # number of the first word of each word shard
    order: int
    shards: int  # grams of each level are sharded by context into so many
    tokens: int
    types: int
    discounts: tuple[tuple[float, float, float], ...]  # of levels 2, 3, ...
    low_discounts: tuple[float, float, float]
    low_total: int
    low_left: float  # gamma'
    written: tuple[int, ...] = ()  # level * SPAN + shard of the shards that hold grams; others have no file

    def save(self) -> None:
        shared.publish(self.folder, "model.json", np.frombuffer(json.dumps(asdict(self)).encode(), np.uint8))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D for counts 1, 2 and 3 or more, from the numbers of entries with counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
    return tuple(float(min(max(d, 0.05), k + 0.95)) for k, d in enumerate(raw))


def _tokens(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with end tokens, first token of each row)."""
    for lo, hi, data, offsets in tb.groups(batch.column(at), GROUP):
        w = tb.words(data, offsets, tb.BLANK_WORD)
        yield lo, hi, np.insert(w.hashes(), w.first[1:], END), w.first + np.arange(len(w.first))


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a), codec="zstd", asbytes=True)


def _unpack(b: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _key(context: list[np.ndarray]) -> np.ndarray:
    """A number for each context, given as columns of token numbers: exact up to two tokens, a hash beyond."""
    if len(context) == 1:
        return context[0].astype(np.uint64)
    key = _pair(*context[:2])
    for c in context[2:]:
        key = tb.mix(key) + c.astype(np.uint64)
    return key


def _shard(first: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    """The shard of grams that begin with a token, of one of the parts that it takes: these are in different shards."""
    return ((tb.mix(first.astype(np.uint64)) % np.uint64(shards)).astype(np.int64) + part) % shards


def _part(rest: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
    """Which of `parts` parts a gram is in, by its tokens but the first."""
    out = np.zeros(len(parts), np.int64)
    many = np.flatnonzero(parts > 1)
    if len(many):
        h = np.zeros(len(many), np.uint64)
        for c in rest:
            h = tb.mix(h + c[many].astype(np.uint64) + tb._STEP)
        out[many] = (h % parts[many].astype(np.uint64)).astype(np.int64)
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _combined(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct grams, in order, and their summed counts; without counts, each counts once.

    Grams of two or three tokens are sorted as one number: of three, the place of the first two among the distinct ones, and the third.
    """
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    if len(columns) > 3:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        at = np.flatnonzero(new)
        return [c[order][at] for c in columns], np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at)
    key, pairs = _pair(*columns[:2]), None
    if len(columns) == 3:
        order = np.argsort(key)
        key = key[order]
        cut = _runs(key)
        pairs = key[cut[:-1]]
        key = _pair(np.repeat(np.arange(len(pairs)), np.diff(cut)), columns[2][order])
        n = None if n is None else n[order]
    if n is None:
        key = np.sort(key)
        cut = _runs(key)
        n, key = np.diff(cut), key[cut[:-1]]
    else:
        order = np.argsort(key)
        key = key[order]
        cut = _runs(key)[:-1]
        n, key = np.add.reduceat(n[order], cut), key[cut]
    first, last = (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32)
    if pairs is None:
        return [first, last], n
    return [(pairs >> np.uint64(32)).astype(np.uint32)[first], pairs.astype(np.uint32)[first], last], n


def _packed_columns(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers as planes of bytes, which compress better."""
    return _pack(np.concatenate([np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.reshape(-1) for c in columns]))


def _unpacked_columns(raw: bytes, columns: int, n: int) -> list[np.ndarray]:
    planes = _unpack(raw, "u1", 4 * columns * n).reshape(columns, 4, n)
    return [np.ascontiguousarray(p.T).view("<u4").reshape(-1) for p in planes]


def _sent(columns: list[np.ndarray], n: np.ndarray, reader: Reader) -> list[tuple]:
    """Distinct grams as rows of GRAMS, one a shard."""
    shard = _shard(columns[0], _part(columns[1:], reader.parts(columns[0])), reader.m.shards)
    order = np.argsort(shard, kind="stable")
    columns, n, shard = [c[order] for c in columns], n[order].astype(np.uint32), shard[order]
    cut = _runs(shard)
    return [(len(columns) * SPAN + int(shard[a]), int(b - a), _packed_columns([c[a:b] for c in columns]), _packed_columns([n[a:b]])) for a, b in zip(cut[:-1], cut[1:])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.binary()])], names=["shard", "n", "g", "c"])


class Numbers:
    """Numbers below 2^32, stored as their two lower bytes and the rest, in one or two bytes."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high

    @staticmethod
    def arrays(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = x >> np.uint32(16)
        return x.astype(np.uint16), high.astype(np.uint8 if not len(x) or int(high.max()) < 256 else np.uint16)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.high[at].astype(np.uint32) << np.uint32(16)) | self.low[at]

    def search(self, a: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Where each wanted number is within a:end, or -1; numbers there are in order."""
        out = np.full(len(a), -1)
        some = np.flatnonzero(a < end)
        here = self[a[some]]
        met = here == wanted[some]
        out[some[met]] = a[some[met]]
        # Most contexts have one word, and are done.
        more = some[(here < wanted[some]) & (end[some] - a[some] > 1)]
        a, stop, wanted = a[more] + 1, end[more], wanted[more]
        b = stop.copy()
        live = np.arange(len(more))
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self[mid] < wanted[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        inside = np.flatnonzero(a < stop)
        good = inside[self[a[inside]] == wanted[inside]]
        out[more[good]] = a[good]
        return out


_EVEN, _ONES = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)
_KINDS = [np.uint64, np.uint8, np.uint32, np.int64, np.int64, np.int64, np.int64, np.uint16, None, np.uint8]


class Grams:
    """A shard of one level: contexts in order, and the words of each in order, with their counts."""

    def __init__(self, raw: np.ndarray):
        head = raw[: 8 * 2 * len(_KINDS)].view(np.int64)
        arrays, at = [], 8 * 2 * len(_KINDS)
        for k, kind in enumerate(_KINDS):
            size, width = int(head[2 * k]), int(head[2 * k + 1])
            arrays.append(raw[at : at + size * width].view(kind or (np.uint8 if width == 1 else np.uint16)))
            if k == 1:  # eight sizes as a number
                self.steps = raw[at : at + -(-size // STEP) * STEP].view("<u8")
            at += -(-size * width // 8) * 8
        self.contexts, self.sizes, self.sample, self.big, self.excess, long, over, words, rest, self.low_counts = arrays
        self.words = Numbers(words, rest)
        self.long, self.over = long.reshape(5, -1), over.reshape(2, -1)

    @staticmethod
    def write(folder: str, name: str, key: np.ndarray, words: np.ndarray, n: np.ndarray) -> None:
        """Grams in order of key and word."""
        begin = _runs(key)
        size = np.diff(begin)
        long, over, big = np.flatnonzero(size > LONG), np.flatnonzero(n >= 255), np.flatnonzero(size >= 255)
        arrays = [
            key[begin[:-1]], np.minimum(size, 255), begin[:-1:STEP], big, np.concatenate([[0], np.cumsum(size[big] - 255)]),
            np.concatenate([long[None], _sums(n, begin[:-1])[:, long]]).reshape(-1), np.concatenate([over, n[over]]), *Numbers.arrays(words), np.minimum(n, 255),
        ]
        arrays = [np.ascontiguousarray(x, kind or x.dtype) for x, kind in zip(arrays, _KINDS)]
        padded = [np.concatenate([x.view(np.uint8), np.zeros(-x.nbytes % 8, np.uint8)]) for x in arrays]
        shared.publish(folder, name, np.array([y for x in arrays for y in (len(x), x.itemsize)], np.int64), *padded)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each context, or -1; contexts asked for are in order."""
        at = np.minimum(np.searchsorted(self.contexts, key), len(self.contexts) - 1)
        return np.where(self.contexts[at] == key, at, -1)

    def bounds(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of contexts begin and end."""
        step = place >> 3
        # The bytes of the sizes before, as one number: added up two by two, and those by a product.
        before = self.steps[step] & ((np.uint64(1) << ((place & 7) << 3).astype(np.uint64)) - np.uint64(1))
        before = (before & _EVEN) + ((before >> np.uint64(8)) & _EVEN)
        begin = self.sample[step] + ((before * _ONES) >> np.uint64(48)).astype(np.int64)
        size = self.sizes[place].astype(np.int64)
        if len(self.big):
            more = [self.excess[np.searchsorted(self.big, x)] for x in (step << 3, place, place + 1)]
            begin += more[1] - more[0]
            size += more[2] - more[1]
        return begin, begin + size

    def counts(self, at: np.ndarray) -> np.ndarray:
        n = self.low_counts[at].astype(np.int64)
        big = np.flatnonzero(n == 255)
        n[big] = self.over[1][np.searchsorted(self.over[0], at[big])]
        return n

    def sums(self, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of contexts: sums of counts, and numbers of words with count 1, 2, 3+."""
        out = np.empty((4, len(place)), np.int64)
        size = end - begin
        single = np.flatnonzero(size == 1)
        n = self.counts(begin[single])
        for k, x in enumerate((n, n == 1, n == 2, n >= 3)):
            out[k, single] = x
        long, short = np.flatnonzero(size > LONG), np.flatnonzero((size > 1) & (size <= LONG))
        out[:, long] = self.long[1:, np.searchsorted(self.long[0], place[long])]
        if len(short):
            size = size[short]
            edge = np.cumsum(size) - size
            out[:, short] = _sums(self.counts(np.repeat(begin[short] - edge, size) + np.arange(size.sum())), edge)
        return out


def _sums(n: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return np.stack([np.add.reduceat(x.astype(np.int64), edge) for x in (n, n == 1, n == 2, n >= 3)])


class Reader:
    """A worker's view of a model: maps shards as they are met."""

    def __init__(self, model: Model):
        self.m, self._words, self._grams, self._written, self._hot = model, {}, {}, set(model.written), None

    def words(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, counts and numbers of contexts."""
        if shard not in self._words:
            n = (*self.m.bases, self.m.types)[shard + 1] - self.m.bases[shard]
            counts = shared.mapped(self.m.folder, f"words-{shard}") if n else np.zeros(0, np.uint8)
            lower = shared.mapped(self.m.folder, f"lower-{shard}").view(np.int64) if n and self.m.low_total else np.zeros(n, np.int64)
            self._words[shard] = counts[: 8 * n].view(np.uint64), counts[8 * n :].view(np.int64), lower
        return self._words[shard]

    def parts(self, token: np.ndarray) -> np.ndarray:
        """Over how many parts the grams that begin with each token are dealt."""
        if self._hot is None:
            self._hot = shared.mapped(self.m.folder, "hot").view(np.int64).reshape(2, -1)
        if not self._hot.shape[1]:
            return np.ones(len(token), np.int64)
        at = np.minimum(np.searchsorted(self._hot[0], token), self._hot.shape[1] - 1)
        return np.where(self._hot[0][at] == token, self._hot[1][at], 1)

    def grams(self, level: int, shard: int) -> Grams | None:
        name = level * SPAN + shard
        if name not in self._grams:
            self._grams[name] = Grams(shared.mapped(self.m.folder, f"grams-{level}-{shard}")) if name in self._written else None
        return self._grams[name]

    def look_up(self, h: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, count, contexts) of distinct, sorted hashes."""
        number, count, contexts = np.full(len(h), -1), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = (h >> np.uint64(64 - self.m.word_bits)).astype(np.int64) if self.m.word_bits else np.zeros(len(h), np.int64)
        cut = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(h)]]) if len(h) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            keys, counts, low = self.words(int(shard[a]))
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
            good = np.flatnonzero(keys[at] == h[a:b])
            number[a + good], count[a + good] = at[good] + self.m.bases[int(shard[a])], counts[at[good]]
            if lower:
                contexts[a + good] = low[at[good]]
        return number, count, contexts

    def _low(self, contexts: np.ndarray) -> np.ndarray:
        m = self.m
        if not m.low_total:
            return np.full(len(contexts), 1 / (m.types + 1))
        d = np.array([0, *m.low_discounts])[np.minimum(contexts, 3)]
        return np.maximum(contexts - d, 0) / m.low_total + m.low_left / (m.types + 1)

    def _found(self, level: int, context: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Grams in order of context, their counts (0 where a gram isn't); sums of the contexts as of Grams.sums, and how many of the grams each has."""
        key = _key(context)
        order = np.argsort(key if level > 2 else _pair(context[0], word))
        cut = _runs(key[order])
        one = order[cut[:-1]]
        firsts, parts = context[0][one], self.parts(context[0][one])
        # A slot is a context in one of the shards over which it is dealt: mostly the only one.
        slots = np.cumsum(parts) - parts
        of = np.repeat(np.arange(len(one)), parts)
        shard = _shard(firsts[of], np.arange(len(of)) - slots[of], self.m.shards)
        size = np.diff(cut)
        mine = np.repeat(slots, size)  # of grams in order
        many = np.repeat(parts, size)
        if (parts > 1).any():
            mine = mine + _part([*(c[order] for c in context[1:]), word[order]], many)
            within = np.argsort(mine, kind="stable")
            order, mine = order[within], mine[within]
        first = np.searchsorted(mine, np.arange(len(of) + 1)) if len(of) != len(one) else cut
        keys, words = key[one][of], word[order].astype(np.uint32)
        by_shard = np.argsort(shard.astype(np.uint16) if self.m.shards < 1 << 16 else shard, kind="stable")
        edge = _runs(shard[by_shard])
        sums, count = np.zeros((4, len(of)), np.int64), np.zeros(len(key), np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            g = self.grams(level, int(shard[by_shard[a]]))
            if g is None:
                continue
            some = by_shard[a:b]
            place = g.find(keys[some])
            if (place < 0).any():
                some, place = some[place >= 0], place[place >= 0]
                if not len(some):
                    continue
            begin, end = g.bounds(place)
            sums[:, some] = g.sums(place, begin, end)
            n = first[some + 1] - first[some]
            asked = np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = g.words.search(np.repeat(begin, n), np.repeat(end, n), words[asked])
            met = at >= 0
            count[asked[met]] = g.counts(at[met])
        if len(of) != len(one):
            sums = np.add.reduceat(sums, slots, axis=1) if len(slots) else sums
            size = np.diff(np.append(first[slots], first[-1]))
        return order, count, sums, size

    def scores(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, tokens whose gram of full order occurs twice or more, base score, model score) of each text."""
        m = self.m
        distinct, back = np.unique(h, return_inverse=True)
        number, count, contexts = self.look_up(distinct)
        word, p = number[back], self._low(contexts)[back]
        place, again = _place(first), np.zeros(len(h), np.int64)
        for level in range(2, m.order + 1):
            at = np.flatnonzero(place >= level - 2)
            context = _context(word, place, at, level, m.types)
            known = np.all([c >= 0 for c in context], axis=0)
            if level > 2:  # a context that is no gram of the next lower order itself isn't there
                known &= seen[at - 1]
            at, context = at[known], [c[known] for c in context]
            # An unknown word is in no context; no number is as large as its stand-in.
            order, c, (total, n1, n2, n3), size = self._found(level, context, np.where(word[at] >= 0, word[at], (1 << 32) - 1))
            d = np.array([0.0, *m.discounts[level - 2]])
            some, total = total > 0, np.maximum(total, 1)
            left = np.where(some, (d[1] * n1 + d[2] * n2 + d[3] * n3) / total, 1.0)  # of no context, all is left
            at = at[order]
            seen = np.zeros(len(h), bool)
            seen[at] = c > 0
            if level == m.order:
                again[at] = c > 1
            p[at] = np.maximum(c - d[np.minimum(c, 3)], 0) / np.repeat(total, size) + np.repeat(left, size) * p[at]
        base = np.log10((count[back] + 1) / (m.tokens + 1 * (m.types + 1)))
        return tuple(np.add.reduceat(x, first[:-1]) for x in ((count[back] > 0).astype(np.int64), again, base, np.log10(p)))


_READERS: dict[Model, Reader] = {}


def reader_of(model: Model) -> Reader:
    """The worker's reader, which outlives its tasks: what isn't on a mounted disk is copied once. Only the last model's is kept."""
    if model not in _READERS:
        _READERS.clear()
        _READERS[model] = Reader(model)
    return _READERS[model]


def _place(first: np.ndarray) -> np.ndarray:
    """How many tokens of its text are before each token."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def _context(word: np.ndarray, place: np.ndarray, at: np.ndarray, level: int, mark: int) -> list[np.ndarray]:
    """The level - 1 tokens before each token of at, the farthest first; the start mark stands before the first of a text."""
    return [np.where(place[at] >= k, word[np.maximum(at - k, 0)], mark) for k in range(level - 1, 0, -1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([x for _, x in held]), minlength=len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for batch in batches:
        for _, _, h, _ in _tokens(batch, 0):
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size > COMBINE_WORDS:
                yield merged()
                held, size = [], 0
    if held:
        yield merged()


def _write_words(batches: Iterator[pa.RecordBatch], folder: str, hot_from: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, h, n) in order of shard: one file a shard; yields its size, its tokens, words with `hot_from` or more, and the number of texts if it has the end token."""
    for shard, t in _by_shard(batches):
        h, n = t["h"].to_numpy().view(np.uint64), t["n"].to_numpy()
        order = np.argsort(h)
        n = n[order].astype(np.int64)
        shared.publish(folder, f"words-{shard}", h[order], n)
        hot = np.flatnonzero(n >= hot_from)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(h)]), pa.array([int(n.sum())]), pa.array([hot], pa.list_(pa.int64())), pa.array([n[hot]], pa.list_(pa.int64())), pa.array([int(n[h[order] == END].sum())])], names=["shard", "size", "tokens", "hot", "counts", "texts"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Tables of the rows of each shard, from rows in order of shard."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]]) if len(shards) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            if current is not None and shards[a] != current:
                yield int(current), pa.Table.from_batches(held)
                held = []
            current = shards[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(current), pa.Table.from_batches(held)


def _count_grams(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Grams of the full order, and shorter ones from the start mark, as rows of GRAMS."""
    reader = reader_of(model)
    held: dict[int, list[list[np.ndarray]]] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        rows = []
        for level in sorted(held):
            columns = [np.concatenate(c) for c in zip(*held.pop(level))]
            rows += _sent(*_combined(columns), reader)
        return _batch(rows)

    for batch in batches:
        for _, _, h, first in _tokens(batch, 0):
            distinct, back = np.unique(h, return_inverse=True)
            word = reader.look_up(distinct, lower=False)[0][back]
            place = _place(first)
            for level in range(2, model.order + 1):
                at = np.flatnonzero(place >= level - 2 if level == model.order else place == level - 2)
                if len(at):
                    held.setdefault(level, []).append([c.astype(np.uint32) for c in (*_context(word, place, at, level, model.types), word[at])])
            size += len(word)
            if size > COMBINE:
                yield packed()
                size = 0
    if held:
        yield packed()


def _shard_grams(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray] | pa.RecordBatch]:
    """(shard, distinct grams in order, counts) of rows of GRAMS in order of shard, merged as they arrive; batches of rows of other levels as they are."""
    parts: list[tuple[list[np.ndarray], np.ndarray]] = []
    current, size, most = -1, 0, 0
    for batch in batches:
        mine = batch.column(0).to_numpy() // SPAN == level
        if not mine.all():
            yield batch.filter(pa.array(~mine))
            batch = batch.filter(pa.array(mine))
        for shard, n, g, c in zip(*(batch.column(k) for k in range(4))):
            shard, n = shard.as_py(), n.as_py()
            if parts and shard != current:
                yield current, *_summed(parts)
                parts, size, most = [], 0, 0
            current = shard
            parts.append((_unpacked_columns(g.as_buffer(), level, n), _unpacked_columns(c.as_buffer(), 1, n)[0].astype(np.int64)))
            size += n
            if size > most + SHARD:
                parts = [_summed(parts)]
                size = most = len(parts[0][1])
    if parts:
        yield current, *_summed(parts)


def _write_grams(batches: Iterator[pa.RecordBatch], model: Model, level: int) -> Iterator[pa.RecordBatch]:
    """Writes the shards of a level from rows of GRAMS; yields those of lower levels, and statistics in rows below SPAN.

    Of level 2 it yields (shard of words, w, contexts) instead, and the statistics as (-1, negative number, value).
    """
    reader = reader_of(model)
    few = np.arange(1, 5)
    for found in _shard_grams(batches, level):
        if isinstance(found, pa.RecordBatch):
            if level > 2:
                yield found
            else:
                for g in found.column(2).to_pylist():
                    yield _pairs_of(*np.frombuffer(g, np.int64).reshape(2, -1), model.bases)
            continue
        shard, columns, n = found
        key = _key(columns[:-1])
        if level > 3:  # hashes aren't in the order of their columns
            order = np.lexsort((columns[-1], key))
            columns, n, key = [c[order] for c in columns], n[order], key[order]
        Grams.write(model.folder, f"grams-{level}-{shard - level * SPAN}", key, columns[-1], n)
        told = np.array([[*(-few - 8 * level), -SHARDS - shard], [*((n == k).sum() for k in few), len(n)]], np.int64)
        if level > 2:
            yield _batch([(shard % SPAN, 5, told.tobytes(), b"")])
            yield _batch(_sent(*_combined(columns[1:]), reader))
        else:
            yield _pairs_of(told[0], told[1], model.bases)
            yield _pairs_of(*np.unique(columns[-1].astype(np.int64), return_counts=True), model.bases)
    shared.release()


#: Statistics: -8 * level - k for the number of a level's grams with count k, and -SHARDS - shard for a shard's grams.
SHARDS = 1 << 40


def _pairs_of(w: np.ndarray, n: np.ndarray, bases: tuple[int, ...]) -> pa.RecordBatch:
    """(shard of words, word number, value); statistics, of negative number, in shard -1."""
    return pa.RecordBatch.from_arrays([pa.array((np.searchsorted(np.array(bases), w, "right") - 1).astype(np.int32)), pa.array(w), pa.array(n)], names=["shard", "w", "n"])


def _summed(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    return _combined([np.concatenate(c) for c in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts]))


def _write_lower(batches: Iterator[pa.RecordBatch], folder: str, bases: tuple[int, ...], types: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, w, n) in order of shard: numbers of contexts in the order of the shard's words."""
    for shard, t in _by_shard(batches):
        dense = np.zeros((*bases, types)[shard + 1] - bases[shard], np.int64)
        dense[t["w"].to_numpy() - bases[shard]] = t["n"].to_numpy()
        shared.publish(folder, f"lower-{shard}", dense)
        few = [int((dense == k).sum()) for k in range(1, 5)] + [int((dense >= 3).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(dense.sum())]), pa.array([few], pa.list_(pa.int64()))], names=["shard", "total", "few"])


def _sharded(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of each shard together and in order; neighbouring shards go to different tasks."""
    return rows.repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard")


def train(texts: DataFrame, text: str = "text", shard_size: int = SHARD, order: int = 2) -> Model:
    """A model of all texts, with grams of up to `order` tokens."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    shared.bounded_batches(spark)
    folder = shared.fresh(spark, "model")
    docs = texts.select(F.col(text).cast("string").alias("text"))
    counted, path = shared.written(docs.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    types = counted.count()
    if types >= (1 << 32) - 1:
        raise ValueError("word numbers take 32 bits")
    bits = (types // min(WORDS, shard_size)).bit_length()
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    parts = max(1, min(1 << bits, 4096))
    kept = "shard int, size long, tokens long, hot array<long>, counts array<long>, texts long"
    with shared.shuffles_removed(spark):
        sizes = _sharded(counted.select(shard.alias("shard"), "h", "n"), parts).mapInArrow(lambda b: _write_words(b, folder, shard_size), kept).collect()
    shared.remove(spark, path)
    size = {r["shard"]: r["size"] for r in sizes}
    bases = tuple(int(x) for x in np.concatenate([[0], np.cumsum([size.get(k, 0) for k in range(1 << bits)])[:-1]]))
    tokens = sum(r["tokens"] for r in sizes)
    shards = min(SPAN - 1, max(1, -(-tokens // shard_size)))
    each = max(shard_size, -(-tokens // shards))
    # No more words are hot than there are shards. The start mark stands as often as there are texts.
    counts = [(bases[r["shard"]] + w, n) for r in sizes for w, n in zip(r["hot"], r["counts"])] + [(types, sum(r["texts"] for r in sizes))]
    hot = np.array(sorted((w, min(shards, 1 + n // each)) for w, n in counts if n >= each), np.int64).reshape(-1, 2)
    shared.publish(folder, "hot", np.ascontiguousarray(hot.T))
    model = Model(folder, bits, bases, order, shards, tokens, types, ((0.5,) * 3,) * (order - 1), (0.5,) * 3, 0, 1.0)

    grams, path = docs.mapInArrow(lambda b: _count_grams(b, model), GRAMS), None
    for level in range(order, 2, -1):
        grams, made = shared.written(_sharded(grams, shards).mapInArrow(lambda b, level=level: _write_grams(b, model, level), GRAMS), "grams")
        if path:
            shared.remove(spark, path)
        path = made
    met, made = shared.written(_sharded(grams, shards).mapInArrow(lambda b: _write_grams(b, model, 2), "shard int, w long, n long").groupBy("shard", "w").agg(F.sum("n").alias("n")), "contexts")
    if path:
        shared.remove(spark, path)
    told = {-r["w"]: r["n"] for r in met.filter("w < 0").collect()}  # four rows a level, and one a shard
    held = tuple(sorted(k - SHARDS for k in told if k >= SHARDS))
    by_level = tuple(discounts([told.get(8 * level + k, 0) for k in range(1, 5)]) for level in range(2, order + 1))
    with shared.shuffles_removed(spark):
        found = _sharded(met.filter("w >= 0"), parts).mapInArrow(lambda b: _write_lower(b, folder, bases, types), "shard int, total long, few array<long>").collect()
    shared.remove(spark, made)
    total = sum(r["total"] for r in found)
    few = np.array([r["few"] for r in found] or [[0] * 5]).sum(axis=0).tolist()
    low = discounts(few[:4])
    left = (low[0] * few[0] + low[1] * few[1] + low[2] * few[4]) / total if total else 1.0
    model = Model(folder, bits, bases, order, shards, tokens, types, by_level, low, total, left, held)
    model.save()
    return model


def scored(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns of `keep`, n_tokens, n_known, n_again, base_score, score, perplexity.

    n_again counts tokens that training texts have twice or more behind the same words: nearly all of a text that occurs twice.
    """
    rows = documents.select(F.col(text).cast("string").alias("_scored"), F.col(doc_id).alias("doc_id"), *keep)
    names = ["doc_id", *keep, "n_tokens", "n_known", "n_again", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        for batch in batches:
            for lo, hi, h, first in _tokens(batch, 0):
                known, again, base, score = reader.scores(h, first)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(1, 2 + len(keep))), pa.array(np.diff(first)), pa.array(known), pa.array(again), pa.array(base), pa.array(score)], names=names)
        shared.release()

    schema = ", ".join([*(f"{c} {t}" for c, t in rows.select("doc_id", *keep).dtypes), "n_tokens long, n_known long, n_again long, base_score double, score double"])
    return rows.mapInArrow(run, schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out().alias("held_out"))
    model = train(documents.filter("NOT held_out"), order=ORDER)
    rows = scored(documents, model, keep=("held_out",))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity", "n_again", (F.col("n_again") / F.col("n_tokens")).alias("share_again"))
