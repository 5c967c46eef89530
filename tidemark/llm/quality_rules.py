"""Quality rules: a decision list learned by sequential covering, emitted as Spark conditions.

``features`` computes, in Spark expressions only, the counts of a text. ``fit`` joins a
bounded sample of the labelled rows with their features, and covers the low-quality
rows one rule after another: a rule grows by the threshold test with the largest
information gain until it covers no good row, is pruned on rows held back, and is
kept while it is precise there. ``judge`` applies the list in order.

The sample is the `max_labels` rows with the smallest hash of their id, so its size
bounds what is broadcast and what the driver holds; counts of the texts themselves
cover every document and every word.

Defined cases: a null text is an empty one; empty texts fail the base (no words). Rows
are judged one by one, so repeated ids give repeated rows. Labels that are null are
left out; of several labels for one id, the lowest quality counts. Without labels of
both classes the list is empty and keeps all that passes the base. Other columns are
not read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_LABELS = 20_000
WINDOW = 5
#: A rule must hold this share of low-quality rows where it was grown, and where it was pruned.
PRECISION = 0.95
MIN_COVER = 5
MAX_TESTS = 4

_SPACE = r"[\x20\x09-\x0D]+"


def _dropped(text: Column, pattern: str) -> Column:
    """How many characters of the ASCII class `pattern` a text has."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("long")


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(windows: Column, size: int) -> Column:
    """How many words stand in windows whose hash occurs twice or more."""

    def of(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
        return F.aggregate(starts, none, lambda a, p: F.struct((a["n"] + p + size - F.greatest(p, a["to"])).alias("n"), (p + size).alias("to")), lambda a: a["n"])

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_once(ordered, of))

    return _once(windows, count)


def features(documents: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, the base counts, and the ratios that rules may test."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(*keep, text.alias("_text"), F.array_remove(F.split(text, _SPACE), "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    word = F.col("_words")
    windows = F.when(F.size(word) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(word) - WINDOW), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    counts = F.struct(
        F.size(word).cast("long").alias("n_words"), F.char_length(F.array_join(word, "")).cast("long").alias("word_chars"),
        _dropped(F.col("_text"), r"[#*$%&|<>]").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("n_lines"), _dropped(F.col("_text"), "[A-Z]").alias("n_upper"), _dropped(F.col("_text"), "[!?]").alias("n_shouts"),
        _repeat_words(windows, WINDOW).alias("n_repeat_words"),
    )
    # The explode of one struct is a fence: a later filter on a count can't be pushed below it, where each
    # mention of a count would compute it again.
    rows = rows.select(*keep, F.explode(F.array(counts)).alias("_counts")).select(*keep, "_counts.*")

    def share(a: str, b: str) -> Column:
        return (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")

    return rows.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_upper", "word_chars"), "shout_share": share("n_shouts", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
    })


TESTED = ("symbol_share", "upper_share", "shout_share", "dup_line_share", "repeat_share", "word_length")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, np.ndarray]) -> np.ndarray:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(operator.and_, (t.holds(x) for t in rule), np.ones(n, bool))


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, names: tuple[str, ...]) -> tuple[float, Test] | None:
    """The threshold test with the largest gain p * (log2 p/(p+n) - log2 P/(P+N))."""
    best, base = None, np.log2(bad.mean())
    for name in names:
        order = np.argsort(x[name], kind="stable")
        v, b = x[name][order], bad[order]
        cut = np.flatnonzero(v[1:] != v[:-1])  # between cut and cut + 1
        p_low, n_low = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        for above, p, n in ((False, p_low, n_low), (True, b.sum() - p_low, (~b).sum() - n_low)):
            if not len(cut):
                continue
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 0 and (best is None or gain[k] > best[0]):
                best = float(gain[k]), Test(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, names: tuple[str, ...], most: int) -> Rule:
    rule: list[Test] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (~bad[live]).any() and bad[live].any():
        found = _best_test({k: v[live] for k, v in x.items()}, bad[live], names)
        if found is None:
            break
        rule.append(found[1])
        live &= found[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows that it wasn't grown on."""

    def worth(r: Rule) -> float:
        c = _covers(r, x, len(bad))
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def cover(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, names: tuple[str, ...] = TESTED, precision: float = PRECISION, min_cover: int = MIN_COVER, max_tests: int = MAX_TESTS) -> list[Rule]:
    """Ordered rules for `bad` rows; rows where `held` is true only prune and accept."""
    rules: list[Rule] = []
    live = np.ones(len(bad), bool)
    while True:
        a, b = live & ~held, live & held
        if not bad[a].any() or bad[a].all():
            return rules
        rule = _grow({k: v[a] for k, v in x.items()}, bad[a], names, max_tests)
        if not rule:
            return rules
        rule = _prune(rule, {k: v[b] for k, v in x.items()}, bad[b])
        hit = _covers(rule, x, len(bad)) & live
        good = [(hit & s & bad).sum() / max(1, (hit & s).sum()) for s in (~held, np.ones(len(bad), bool))]
        if hit.sum() < min_cover or min(good) < precision:
            return rules
        rules.append(rule)
        live &= ~hit


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", max_labels: int = MAX_LABELS) -> list[Rule]:
    """A decision list for rows with quality 0, from at most `max_labels` labelled rows."""
    one = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(quality) == 0).alias("bad"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = features(docs, "text", ("doc_id", "bad")).select("doc_id", "bad", *TESTED).orderBy("doc_id", *TESTED).limit(2 * max_labels).collect()
    if not rows:
        return []
    bad = np.array([r["bad"] for r in rows])
    x = {name: np.array([r[name] for r in rows], float) for name in TESTED}
    return cover(x, bad, np.arange(len(rows)) % 3 == 2)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 0; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(reduce(operator.and_, (t.column() for t in rules[k])), k).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(documents: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: its counts, base_failed, the rule that rejects it, and kept."""
    rows = features(documents, text, (doc_id, *keep))
    return rows.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def passed(documents: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    rows = documents.select(F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_document"))
    return judge(rows, rules, "_document").filter("kept").select("_document.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(documents, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
