"""Secret scans: a trigram inverted index proposes documents for each rule; the regex verifies.

``trigram_query`` reads a rule's regex and derives what any match must contain, as a
Boolean query over trigrams. ``postings`` lists, for each trigram that some query
names, the documents that have it; ``candidates`` intersects and unites those postings
as each query says. Rules whose regex has no mandatory trigram scan every document.
Verification works on whole texts, and turns the pieces between matches into spans:
for pieces p0 m0 p1 m1 ..., match k begins where the lengths before it end.

The index is case-folded, so it proposes a superset of what a regex can match. Only
DataFrame expressions are used.

Defined cases: a null or empty text has no spans; a null id is always a candidate.
Rows with the same id share their postings and are verified each on its own text, so
repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import shared

#: A regex piece with more alternatives than this isn't followed exactly.
MOST_STRINGS = 24
#: Candidates (an id and their kinds) that may be broadcast.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # syntax that Python and Java read alike
    group: int = 0  # this group must have at least `least` characters
    least: int = 0
    base: bool = False


# Formats of credentials.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)

#: A query is True (any text), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple[str, frozenset]


def _join(kind: str, parts: list[Query]) -> Query:
    flat: set[Query] = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    if kind == "or":  # a conjunction that demands more than another one adds nothing
        parts_of = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in flat}
        flat = {q for q, p in parts_of.items() if not any(o < p for o in parts_of.values())}
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_strings(strings: set[str]) -> Query:
    """Trigrams that cover each string, side by side; the last one may overlap. A string around another adds nothing."""
    strings = {s for s in strings if not any(o in s and o != s for o in strings)}
    return _join("or", [_join("and", [s[k : k + 3] for k in sorted({*range(0, len(s) - 2, 3), max(0, len(s) - 3)}) if len(s) > 2]) for s in sorted(strings)])


#: A token of a regex: an escape, a class, the start of a group, a repetition, or one character.
_TOKEN = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[aimsux]+\)|\(\?:|\{\d+(?:,\d*)?\}|.", re.S)
#: Escapes that stand for a character; other escaped letters stand for several or for a place.
_PLACES = frozenset("bBAZz")
_CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v"}

#: ("char", c) | ("any", characters or None) | ("place",) | ("branch", sequences) | ("repeat", least, most, node)
Node = tuple


def _escaped(token: str) -> Node:
    if token[1] in "xu" and len(token) > 2:
        return "char", chr(int(token[2:], 16))
    if token[1] in _PLACES:
        return ("place",)
    if token[1] in _CONTROL:
        return "char", _CONTROL[token[1]]
    if token[1].isalnum():  # a class of characters, or a reference
        return "any", None
    return "char", token[1]


def _members(token: str) -> Node:
    """A class of characters, if it lists them one by one."""
    inner = re.findall(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)|.", token[1:-1], re.S)
    parts = [_escaped(x) if x[0] == "\\" else ("char", x) for x in inner]
    listed = inner[:1] != ["^"] and all(kind == "char" for kind, *_ in parts) and "-" not in inner[1:-1]
    return "any", {c for _, c in parts} if listed else None


def parsed(pattern: str) -> list[list[Node]]:
    """The alternatives of a regex, as sequences of nodes. Groups are plain or (?:...); look-around isn't known."""
    tokens = _TOKEN.findall(pattern)
    at = 0

    def alternatives(depth: int) -> list[list[Node]]:
        nonlocal at
        out: list[list[Node]] = [[]]
        while at < len(tokens):
            t = tokens[at]
            at += 1
            if t == ")":
                if not depth:
                    raise ValueError(f"unbalanced parenthesis: {pattern}")
                return out
            if t == "|":
                out.append([])
            elif t in ("(", "(?:"):
                if t == "(" and at < len(tokens) and tokens[at] == "?":
                    raise ValueError(f"unknown group: {pattern}")
                out[-1].append(("branch", alternatives(depth + 1)))
            elif len(t) > 2 and t.startswith("(?"):
                pass  # flags
            elif t in "*+?" or t[0] == "{" and len(t) > 1:
                low, _, high = {"*": "0,", "+": "1,", "?": "0,1"}.get(t, t.strip("{}")).partition(",")
                most = int(low) if t[0] == "{" and "," not in t else int(high) if high else None
                if at < len(tokens) and tokens[at] in ("?", "+"):  # how eagerly it repeats
                    at += 1
                out[-1].append(("repeat", int(low), most, out[-1].pop()))
            elif t in "^$":
                out[-1].append(("place",))
            elif t == ".":
                out[-1].append(("any", None))
            elif t[0] == "[" and len(t) > 1:
                out[-1].append(_members(t))
            else:
                out[-1].append(_escaped(t) if t[0] == "\\" else ("char", t))
        if depth:
            raise ValueError(f"unbalanced parenthesis: {pattern}")
        return out

    return alternatives(0)


def _either(found: list[tuple[set[str] | None, Query]]) -> tuple[set[str] | None, Query]:
    if all(s is not None for s, _ in found):
        return set().union(*(s for s, _ in found)), True
    return None, _join("or", [_join("and", [q] + ([_of_strings(s)] if s is not None else [])) for s, q in found])


def _analyse(nodes: list[Node]) -> tuple[set[str] | None, Query]:
    """(all strings that the nodes can match, or None if that is unknown or too many; what a match must contain)."""
    exact: set[str] | None = {""}
    live, must = {""}, []  # strings that end at the current place; what was left behind

    def meet(strings: set[str] | None, query: Query) -> None:
        nonlocal exact, live
        must.append(query)
        longer = None if strings is None else {a + b for a, b in product(live, strings)}
        if longer is None or len(longer) > MOST_STRINGS:
            must.append(_of_strings(live))
            exact, live = None, strings if strings and len(strings) <= MOST_STRINGS else {""}
        else:
            live = longer

    for kind, *value in nodes:
        if kind == "char":
            meet({value[0].lower()}, True)
        elif kind == "any":
            meet(None if value[0] is None else {c.lower() for c in value[0]}, True)
        elif kind == "branch":
            meet(*_either([_analyse(x) for x in value[0]]))
        elif kind == "repeat":
            low, high, sub = value
            strings, query = _analyse([sub])
            if (low, high) == (0, 1):
                meet(None if strings is None else strings | {""}, True)
            elif low == high == 1:
                meet(strings, query)
            else:
                meet(None, query if low else True)
    if exact is None:
        return None, _join("and", [*must, _of_strings(live)])
    return live, _join("and", must)


def trigram_query(pattern: str) -> Query:
    """What a text must contain, in lower case, for the pattern to match; True if that is unknown."""
    strings, query = _either([_analyse(x) for x in parsed(pattern)])
    return query if strings is None else _join("and", [query, _of_strings(strings)])


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def _holds(query: Query, bits: Column, number: dict[str, int]) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.get(bits, F.lit(number[query] // 60)).bitwiseAND(F.lit(1 << number[query] % 60).cast("long")) != 0
    parts = [_holds(q, bits, number) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(documents: DataFrame, wanted: list[str], doc_id: str, text: str) -> DataFrame:
    """(trigram number, doc_id) for each wanted trigram that a document has."""
    # The explode of one text is a fence: without it the text is lower-cased again for each trigram.
    found = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(F.array(F.lower(text))).alias("t"))
    has = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(g)), n) for n, g in enumerate(wanted)]))
    return found.select("doc_id", has.alias("has")).select(F.explode("has").alias("trigram"), "doc_id")


def candidates(posted: DataFrame, queries: dict[str, Query], wanted: list[str]) -> DataFrame:
    """doc_id and the kinds whose query its postings meet; only documents that meet some query."""
    number = {g: n for n, g in enumerate(wanted)}
    words = [F.bit_or(F.when(F.floor(F.col("trigram") / 60) == k, F.expr("shiftleft(1L, CAST(trigram % 60 AS INT))"))) for k in range(len(wanted) // 60 + 1)]
    met = posted.groupBy("doc_id").agg(F.array(*[F.coalesce(w, F.lit(0).cast("long")) for w in words]).alias("bits"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("bits"), number), kind) for kind, q in queries.items()]))
    return met.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _found(rule: Rule, text: Column) -> Column:
    """array<struct<start, end>> of a rule's accepted matches, in code points."""
    pieces, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(whole)), lambda x: F.char_length(x)).alias("gap"), F.transform(whole, lambda x: F.char_length(x)).alias("n"), F.transform(tested, lambda x: F.char_length(x)).alias("tested"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["n"]).alias("end"))
        return F.struct((start + p["n"]).alias("at"), F.when(p["tested"] >= rule.least, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(parts, none, step, lambda a: a["spans"])


def _tagged(found: Column, number: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, text, found: array<struct<start, kind number, kind, end>> in order, and the columns of `keep` in a struct, kept."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    wanted = sorted(set().union(*(trigrams(q) for q in indexed.values())))
    able, _ = shared.written(candidates(postings(docs, wanted, "doc_id", "text"), indexed, wanted).withColumnRenamed("doc_id", "able_id"), "candidates")
    # A bounded number of ids is broadcast, so that the texts stay where they are; more are joined by a shuffle.
    few = able.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(able) if few else able.hint("merge"), F.col("doc_id") == F.col("able_id"), "left")
    spans = []
    for n, rule in enumerate(rules):
        # Where no trigram is mandatory, a search for the regex comes before the slower extraction.
        proposed = (F.array_contains("kinds", rule.kind) | F.col("doc_id").isNull()) if rule.kind in indexed else F.col("text").rlike(rule.pattern)
        spans.append(F.when(proposed, _tagged(_found(rule, F.col("text")), n, rule.kind)).otherwise(F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")))
    return rows.select("doc_id", "text", "kept", F.array_sort(F.concat(*spans)).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the text with each span (overlapping ones as one) replaced by `mask`, found, and kept (see scan)."""
    rows = scan(documents, doc_id, text, rules, keep)
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), gap.alias("out"))

    clean = F.aggregate("found", none, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    return rows.select("doc_id", F.when(F.size("found") > 0, clean).otherwise(F.col("text")).alias("text"), "found", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = F.col("found")
    n = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda s: s["number"] < sum(r.base for r in RULES))
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"))


def _spans_sql(number: int, rule: Rule) -> str:
    """Matches of one rule: pieces between matches and the matches' lengths give their places."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""
  SELECT row, {number} AS number, '{rule.kind}' AS kind, p[1] AS start, p[2] AS stop
  FROM (
    SELECT row, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda k: length(t[k]) >= {rule.least}), lambda k: [
        coalesce(list_sum(list_transform(g[1 : k], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0)::BIGINT,
        coalesce(list_sum(list_transform(g[1 : k], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1 : k], lambda x: length(x))), 0)::BIGINT])) AS p
    FROM (SELECT row, string_split_regex(text, {pattern}) AS g, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS t FROM doc))"""


ORACLE_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({" UNION ALL ".join(_spans_sql(n, r) for n, r in enumerate(RULES))}),
found AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, number) FILTER (number < {sum(r.base for r in RULES)}) AS base,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, number) AS spans
  FROM span GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN found USING (row)
"""
