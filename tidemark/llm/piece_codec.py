"""SentencePiece BPE encoding and decoding by suffix-array matching.

A text is cut into units: a run of spaces and the characters up to the next space. No
piece crosses a unit, so equal units are encoded once. For the units of a batch that
are new to the worker:

1. their texts, each with its leading spaces, are concatenated and indexed by a suffix
   array (sorted as deep as the longest piece that may stand there);
2. every piece of the vocabulary is binary-searched, all pieces at once, for the range
   of suffixes that begin with it: each suffix in the range is an edge;
3. edges are sorted by the place in the unit where they begin;
4. edges are relaxed in that order. For BPE, a prefix has exactly one last piece: the one
   whose predecessor, the last piece of the shorter prefix, stays a neighbour of it when
   the two are encoded together. Verdicts on pairs of neighbours are kept.

A character that no piece covers is an edge of its own, and becomes its UTF-8 bytes. A
unit of any length is indexed in parts of bounded size, whose edges reach into the next
part; a worker's memory is bounded by bytes but for the text itself and 8 bytes for each
of its own. The result equals that of the sentencepiece library.

Decoding joins the pieces' bytes, turns space marks into spaces and drops the first.

Defined cases: a null text has null ids; an empty one has none. The space mark U+2581 in
a text counts as a space, so it decodes to a space. Repeated rows give repeated rows.
Ids that form no valid UTF-8 decode with replacement characters. Models other than BPE
with byte fallback, an identity normaliser and a dummy prefix are refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import shared, textbuf as tb

MARK = "▁"
_MARK = MARK.encode()
_SPACE = np.arange(256) != 0x20
#: Bytes of remembered units after which a worker starts anew, and places for verdicts on pairs of neighbours, twice 9 bytes each.
HELD, PAIRS = 16 << 20, 600_000
#: Bytes of texts that are handled together, and of units in one suffix array.
GROUP, INDEXED = 1 << 20, 1 << 17
#: Edges that are relaxed one by one rather than as an array.
FEW = 12


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's vocabulary, and exact BPE of single short strings."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.text) if self.plain[i]}
        self.byte = np.full(256, -1)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(self.text[i][1:-1], 16)] = i
        probe = "a  b ﬁ"
        if (self.byte < 0).any() or model.decode(model.encode(probe)) != probe or any(MARK in p.lstrip(MARK) for p in self.id) or model.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("a BPE model with byte fallback, identity normaliser and dummy prefix is needed")
        raw = [self.text[i].replace(MARK, " ").encode() if self.plain[i] else b"" for i in range(n)]
        for b in range(256):
            raw[self.byte[b]] = bytes([b])
        self.first = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        # Pieces with spaces for their marks, as big-endian words.
        found = [(self.text[i].replace(MARK, " ").encode(), i) for i in self.id.values()]
        self.deep = max(len(b) for b, _ in found) // 8 + 1
        wide = lambda fill: np.array([np.frombuffer(b.ljust(8 * self.deep, fill), ">u8") for b, _ in found]).astype(np.uint64)
        self.low, self.high, self.ids = wide(b"\0"), wide(b"\xff"), np.array([i for _, i in found])
        self.size = np.array([len(b) for b, _ in found])
        self.n = n

    def bpe(self, text: str) -> list[int]:
        """Ids of a string of marks and characters: the best-scored neighbours merge first, the leftmost of equals."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols):
                joined = symbols[a] + symbols[b]
                if joined in self.id:
                    heapq.heappush(queue, (-self.score[self.id[joined]], a, b, joined))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if symbols[a] is None or symbols[b] is None or after[a] != b or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, None
            after[a] = after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for s in symbols:
            if s is not None:
                out += [self.id[s]] if s in self.id else [int(self.byte[b]) for b in s.encode()]
        return out


class Encoder:
    """Encodes groups of texts; remembers units and pairs of neighbours, each up to a number of bytes."""

    def __init__(self, path: str):
        self.p = Pieces(path)
        self.forget()
        self.tables = [(np.full(PAIRS, -1), np.zeros(PAIRS, bool), shift) for shift in (0, 30)]
        self.pairs: dict[int, bool] = {}

    def forget(self) -> None:
        self.hash, self.begin, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _verdict(self, left: int, right: int) -> bool:
        return self.p.bpe(self.p.text[left] + self.p.text[right]) == [left, right]

    def _pair(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when encoded together."""
        if left == self.p.n or right == self.p.n:
            return True
        code = left * self.p.n + right
        good = self.pairs.get(code)
        if good is None:
            if len(self.pairs) >= PAIRS // 10:
                self.pairs.clear()
            good = self.pairs[code] = self._verdict(left, right)
        return good

    def _neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_pair for arrays. Verdicts stand in one of two places of a table of fixed size, and the latest takes the place of an older one."""
        code = left.astype(np.int64) * (self.p.n + 1) + right
        good = (left == self.p.n) | (right == self.p.n)
        todo = np.flatnonzero(~good)
        for table, verdicts, shift in self.tables:
            here = self._place(code[todo], shift)
            met = table[here] == code[todo]
            good[todo[met]] = verdicts[here[met]]
            todo = todo[~met]
        if len(todo):
            new, back = np.unique(code[todo], return_inverse=True)
            found = np.array([self._verdict(a, b) for a, b in zip((new // (self.p.n + 1)).tolist(), (new % (self.p.n + 1)).tolist())])
            good[todo] = found[back]
            (one, of_one, shift), (two, of_two, other) = self.tables
            at = self._place(new, shift)
            free = one[at] < 0
            one[at[free]], of_one[at[free]] = new[free], found[free]  # of two in one place the later one stays, in both arrays
            late = one[at] != new
            at = self._place(new[late], other)
            two[at], of_two[at] = new[late], found[late]
        return good

    @staticmethod
    def _place(code: np.ndarray, shift: int) -> np.ndarray:
        h = tb.mix(code.astype(np.uint64))
        return ((h >> np.uint64(shift)) % np.uint64(PAIRS)).astype(np.int64)

    def _edges(self, view: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in starts, size, piece) of each piece at each of the places `starts`, from a suffix array over them.

        Suffixes are sorted by their first eight bytes, and deeper where a longer piece may stand.
        """
        p = self.p
        first = view[starts].astype(np.uint64)
        order = np.argsort(first, kind="stable")
        first = first[order]
        lo, hi = np.searchsorted(first, p.low[:, 0]), np.searchsorted(first, p.high[:, 0], "right")
        whole = [(lo, hi, order, np.flatnonzero((hi > lo) & (p.size <= 8)))]
        long = np.flatnonzero((hi > lo) & (p.size > 8))
        if len(long):
            step = np.zeros(len(order) + 1, np.int32)
            np.add.at(step, lo[long], 1)
            np.subtract.at(step, hi[long], 1)
            some = order[np.cumsum(step[:-1]) > 0]
            keys = [view[starts[some] + 8 * k].astype(np.uint64) for k in range(p.deep)]
            deep = np.lexsort(keys[::-1])
            keys = [k[deep] for k in keys]

            def bound(target: np.ndarray, upper: bool) -> np.ndarray:
                lo, hi = np.zeros(len(target), np.int64), np.full(len(target), len(some))
                while (open_ := lo < hi).any():
                    mid = np.minimum((lo + hi) // 2, len(some) - 1)
                    less, same = np.zeros(len(target), bool), np.ones(len(target), bool)
                    for k in range(p.deep):
                        here = keys[k][mid]
                        less |= same & (here < target[:, k])
                        same &= here == target[:, k]
                    go = (less | (same & upper)) & open_
                    lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
                return lo

            lo, hi = lo.copy(), hi.copy()
            lo[long], hi[long] = bound(p.low[long], False), bound(p.high[long], True)
            whole.append((lo, hi, some[deep], long))
        at, piece = [], []
        for lo, hi, places, which in whole:
            n = (hi - lo)[which]
            piece.append(np.repeat(which, n))
            at.append(places[np.repeat(lo[which] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        at, piece = np.concatenate(at), np.concatenate(piece)
        return at.astype(np.int32), p.size[piece].astype(np.int32), p.ids[piece].astype(np.int32)

    def _relax(self, view: np.ndarray, starts: np.ndarray, origin: np.ndarray, wide: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """Follows the edges that begin at `starts`: the last piece of each prefix that they end, and where it begins."""
        at, size, piece = self._edges(view, starts)
        alone = np.zeros(len(starts), bool)
        alone[at[size == wide[at]]] = True
        bare = np.flatnonzero(~alone).astype(np.int32)
        at, size, piece = np.concatenate([at, bare]), np.concatenate([size, wide[bare]]), np.concatenate([piece, np.full(len(bare), self.p.n, np.int32)])
        depth = (starts - origin)[at]
        order = np.argsort(depth, kind="stable")
        depth, at, piece = depth[order], at[order], piece[order]
        start = starts[at]
        end = start + size[order]
        cuts = np.concatenate([[0], np.flatnonzero(depth[1:] != depth[:-1]) + 1, [len(depth)]])
        many = np.flatnonzero(np.diff(cuts) >= FEW)
        k, n_cuts = 0, len(cuts) - 1
        while k < n_cuts:
            following = int(np.searchsorted(many, k))
            j = int(many[following]) if following < len(many) else n_cuts
            if j > k:  # places of few units: one edge at a time
                a, b = int(cuts[k]), int(cuts[j])
                ends: dict[int, tuple[int, int]] = {}
                for s, e, t, head in zip(start[a:b].tolist(), end[a:b].tolist(), piece[a:b].tolist(), (depth[a:b] == 0).tolist()):
                    if not head:
                        before = ends[s][0] if s in ends else int(last[s])
                        if before < 0 or not self._pair(before, t):
                            continue
                    ends[e] = t, s
                if ends:
                    where = np.fromiter(ends, np.int64, len(ends))
                    found = np.array(list(ends.values()), np.int32)
                    last[where], back[where] = found[:, 0], found[:, 1]
                k = j
            else:
                s, e, t = start[cuts[k] : cuts[k + 1]], end[cuts[k] : cuts[k + 1]], piece[cuts[k] : cuts[k + 1]]
                if depth[cuts[k]]:
                    reached = np.flatnonzero(last[s] >= 0)
                    good = reached[self._neighbours(last[s[reached]], t[reached])]
                    s, e, t = s[good], e[good], t[good]
                last[e], back[e] = t, s
                k += 1

    def _encode_units(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one unit after another, number of ids of each) for units of spaces and characters; a zero byte follows each."""
        unknown = self.p.n
        padded = np.zeros(len(data) + 8 * self.p.deep, np.uint8)
        padded[: len(data)] = data
        view = np.ndarray(len(data) + 8 * (self.p.deep - 1) + 1, ">u8", padded.data, strides=(1,))
        inner = np.ones(len(data), bool)
        inner[stop] = False
        chars = np.flatnonzero(((data & 0xC0) != 0x80) & inner).astype(np.int32)
        lead = data[chars]
        wide = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))).astype(np.int32)
        last, back = np.full(len(data) + 1, -1, np.int32), np.zeros(len(data) + 1, np.int32)
        # More than one part only if there is one unit; a part's edges may end in the next one.
        for lo in range(0, len(chars), INDEXED):
            part = chars[lo : lo + INDEXED]
            self._relax(view, part, begin[np.searchsorted(begin, part, "right") - 1].astype(np.int32), wide[lo : lo + INDEXED], last, back)
        if (last[stop] < 0).any():
            raise RuntimeError("a unit has no path of pieces")
        tokens, units, spots, live, cur = [], [], [], np.arange(len(begin)), stop.copy()
        step, steps = 0, []
        while len(live) >= FEW:
            tokens.append(last[cur])
            cur = back[cur]
            units.append(live)
            spots.append(cur)
            steps.append(np.full(len(live), -step))
            step += 1
            on = cur > begin[live]
            live, cur = live[on], cur[on]
        for unit, c in zip(live.tolist(), cur.tolist()):
            path, head = [c], int(begin[unit])
            while c > head:
                c = int(back[c])
                path.append(c)
            path = np.array(path, np.int64)
            tokens.append(last[path[:-1]])
            units.append(np.full(len(path) - 1, unit))
            spots.append(path[1:])
            steps.append(-step - np.arange(len(path) - 1))
        token, unit, spot, step = (np.concatenate(x) for x in (tokens, units, spots, steps))
        order = np.lexsort((step, unit))
        token, unit, spot = token[order], unit[order], spot[order]
        lead = data[spot]
        many = np.where(token == unknown, np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))), 1)
        ids = np.repeat(token, many)
        raw = np.flatnonzero(ids == unknown)
        offset = raw - np.repeat(np.cumsum(many) - many, many)[raw]
        ids[raw] = self.p.byte[data[np.repeat(spot, many)[raw] + offset]]
        return ids, np.bincount(unit, weights=many, minlength=len(begin)).astype(np.int32)

    def _learn(self, w: tb.Words, spaces: np.ndarray, hashes: np.ndarray, some: np.ndarray) -> None:
        """Encodes the units `some` (one for each new hash) and remembers them."""
        parts, counts = [], []
        part = (np.cumsum(w.end[some] - w.start[some] + spaces[some] + 1) - 1) // INDEXED
        for units in np.split(some, np.flatnonzero(np.diff(part)) + 1):
            size = w.end[units] - w.start[units]
            stop = np.cumsum(size + spaces[units] + 1) - 1
            data = np.full(int(stop[-1]) + 1, 0x20, np.uint8)
            data[stop] = 0
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            data[np.repeat(stop - size, size) + inner] = w.data[np.repeat(w.start[units], size) + inner]
            ids, count = self._encode_units(data, stop - size - spaces[units], stop)
            parts.append(ids)
            counts.append(count)
        count = np.concatenate(counts)
        begin = (len(self.ids) + np.cumsum(count) - count).astype(np.int32)
        hashes, begin, count = np.concatenate([self.hash, hashes[some]]), np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.begin, self.count = hashes[order], begin[order], count[order]
        self.ids = np.concatenate([self.ids, *parts])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) for texts in one buffer."""
        raw = data.tobytes()
        if _MARK in raw:
            texts = [raw[a:b].replace(_MARK, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        w = tb.words(data, offsets, _SPACE, lower=False)
        size = np.diff(offsets)
        doc = w.doc()
        tail = np.flatnonzero((size > 0) & (data[np.maximum(offsets[1:], 1) - 1] == 0x20)) if len(data) else np.zeros(0, np.int64)
        start, end, doc = np.concatenate([w.start, offsets[tail + 1]]), np.concatenate([w.end, offsets[tail + 1]]), np.concatenate([doc, tail])
        order = np.lexsort((start, doc))  # a unit of spaces at its text's end comes after its words
        start, end, doc = start[order], end[order], doc[order]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
        before = np.concatenate([[0], end[:-1]])
        head = np.concatenate([[True], doc[1:] != doc[:-1]])
        spaces = np.where(head, start - offsets[doc] + 1, start - before)
        units = tb.Words(w.data, start, end, np.searchsorted(doc, np.arange(len(size) + 1)))
        h = tb.mix(units.hashes() + spaces.astype(np.uint64) * tb._STEP)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == distinct[inside]
        if not known.all():
            self._learn(units, spaces, h, first[~known])
            at = np.searchsorted(self.hash, distinct)
        begin, count = self.begin[at][back], self.count[at][back]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        if 16 * len(self.hash) + 4 * len(self.ids) > HELD:
            self.forget()
        return ids, total[units.first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which outlives its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decode(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """UTF-8 bytes of texts whose ids stand one after another."""
    n = np.diff(p.first)[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    raw = p.raw[np.repeat(p.first[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
    cut = total[offsets].tolist()
    return [raw[a + 1 : b] if b > a and raw[a] == 0x20 else raw[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _masked(values: pa.Array, null: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(null), pa.scalar(None, values.type), values) if null.any() else values


def encoded(documents: DataFrame, text: str = "text", model: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of `keep` (all by default), ids: array<int>, and round_trip: whether decoding gives the text.

    A round trip allows for U+2581, which decodes to a space. Input columns named ids or round_trip are left out.
    """
    shared.bounded_batches(documents.sparkSession)
    keep = tuple(c for c in (keep if keep is not None else documents.columns) if c not in ("ids", "round_trip"))
    path = model or default_model()
    # A text that is kept is sent to the workers once.
    kept_text = text in keep and dict(documents.dtypes)[text] == "string"
    place = keep.index(text) if kept_text else len(keep)
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], *([] if kept_text else [F.col(text).cast("string").alias("ids")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            column = batch.column(place)
            for lo, hi, data, offsets in tb.groups(column, GROUP):
                ids, first = codec.encode(data, offsets)
                raw = data.tobytes()
                back = decode(codec.p, ids, first)
                same = [x == (y.replace(_MARK, b" ") if _MARK in y else y) for x, y in zip(back, (raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())))]
                null = column.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                lists = _masked(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())), null)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), lists, _masked(pa.array(same, pa.bool_()), null)], names=[*keep, "ids", "round_trip"])
        shared.release()

    schema = ", ".join([*(f"`{c}` {t}" for c, t in documents.select(*[F.col(f"`{c}`") for c in keep]).dtypes), "ids array<int>", "round_trip boolean"])
    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, ids: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """The other columns of rows, and the text of the ids; null ids have a null text."""
    keep = [c for c in rows.columns if c not in (ids, out)]
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = encoder(path).p
        for batch in batches:
            lists = batch.column(len(keep))
            first = np.concatenate([[0], np.cumsum([0 if n is None else n for n in lists.value_lengths().to_pylist()])]).astype(np.int64)
            texts = [t.decode("utf-8", "replace") for t in decode(p, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first)]
            null = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), _masked(pa.array(texts, pa.string()), null)], names=[*keep, out])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*[F.col(f"`{c}`") for c in keep]).dtypes), f"`{out}` string"])
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col(ids)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "round_trip", "ids")
