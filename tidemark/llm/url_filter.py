"""URL filters: host rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

Each term of the vocabulary has a weight. A url without a fitting rule is blocked if the weights
of its different terms add up to `limit` or more: one strict term, whose weight is the
limit, or several soft ones. A term counts only between boundaries: the characters next
to it are not ASCII letters or digits. Overlapping terms all count; a repeated term counts
once. Terms may hold any characters but A-Z; a vocabulary is a mapping or a file of
(term, weight), of at most `MOST_TERMS` terms, which every worker holds.

Defined cases: a null or empty url, and one without ``://``, has an empty host and
path, so no rule fits; a null url has no terms and is allowed. Rows, ties and repeats
included, give one row each. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EDGE = set(LOWER + "0123456789")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
LIMIT = 2.0
MOST_TERMS = 1_000_000

# Terms on any one of which a url is blocked.
STRICT = tuple(
    """
    adult adultchat adultdating bestiality camgirl camgirls camsex casino casinos cialis cumshot fleshlight hentai incest keygen levitra
    masturbation milf nsfw onlinecasino porn porno pornhub pornstar sexcam sexcams sexchat sextoys spam upskirt viagra warez webcamsex xanax xxx
    """.split()
)
# Terms of which a url must hold several.
SOFT = tuple(
    """
    bet bets betting bingo blackjack bonus brides cheap clickbait coupon coupons cracked cracks dating debt diet erotic escort escorts
    fetish flirt forex free gambling hardcore hookup hookups jackpot jackpots keylogger kinky lingerie loan loans lottery lotto lucky malware
    millionaire naked nude nudes nudity payday penis pharmacy phishing pill pills poker prescription prize prizes ransomware refinance replica
    rolex roulette sex sexy singles slots spyware steroids strippers sweepstakes swingers tramadol trojan unlimited voyeur weightloss win winner winners
    """.split()
)
#: Weights of terms. A strict one is as heavy as the limit.
VOCABULARY: dict[str, float] = dict.fromkeys(SOFT, 1.0) | dict.fromkeys(STRICT, LIMIT)


def vocabulary_from(spark: SparkSession, path: str) -> dict[str, float]:
    """A vocabulary from CSV files with the columns term and weight; of several weights of a term the largest."""
    rows = spark.read.schema("term string, weight double").csv(path, header=True, mode="FAILFAST").dropna()
    rows = rows.groupBy(F.translate("term", UPPER, LOWER).alias("term")).agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    return {r["term"]: r["weight"] for r in rows}


def _first(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased."""
    return F.translate(_first(url, r"(?s)^.*?://([^/?#]*)"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return _first(url, r"(?s)^.*?://[^/?#]*([^?#]*)")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def automaton(vocabulary: Mapping[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        if term:
            found.add_word(term, (term, float(weight)))
    found.make_automaton()
    return found


def hits(found: ahocorasick.Automaton, url: str) -> dict[str, float]:
    """The different terms between boundaries, and their weights."""
    out = {}
    for last, (term, weight) in found.iter(url) if len(found) else ():
        before, after = url[last - len(term) : last - len(term) + 1] if last >= len(term) else "", url[last + 1 : last + 2]
        if before not in _EDGE and after not in _EDGE:
            out[term] = weight
    return out


def term_hits(url: Column, vocabulary: Mapping[str, float] = VOCABULARY, limit: float = LIMIT) -> Column:
    """struct<n_strict, n_soft, weight> of a url whose A-Z are lower-cased: different terms as heavy as the limit, others, and their weights' sum."""

    @F.pandas_udf("n_strict long, n_soft long, weight double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(vocabulary)
        for urls in batches:
            weights = [list(hits(found, u).values()) if u else [] for u in urls]
            yield pd.DataFrame([(sum(w >= limit for w in x), sum(w < limit for w in x), float(sum(x))) for x in weights], columns=["n_strict", "n_soft", "weight"])

    return count(url)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, vocabulary: Mapping[str, float] = VOCABULARY, limit: float = LIMIT) -> DataFrame:
    """One row a url: its id, host, path, rule, verdict, n_strict, n_soft and weight."""
    if len(vocabulary) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), term_hits(F.translate(url, UPPER, LOWER), vocabulary, limit).alias("terms"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_terms = F.when(F.col("terms.weight") >= limit, "block").otherwise("allow")
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "terms.n_strict", "terms.n_soft", "terms.weight")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _met(weight: float) -> str:
    """How many different terms of this weight a url has. A boundary character may serve two neighbours, so it is doubled."""
    terms = "|".join(re.escape(t) for t, w in sorted(VOCABULARY.items()) if w == weight)
    return f"len(list_distinct(regexp_extract_all(twice, '(?:^|[^a-z0-9])({terms})(?:[^a-z0-9]|$)', 1)))"


ORACLE_SQL = f"""
WITH split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '([^a-z0-9])', '\\1\\1', 'g') AS twice
  FROM pages),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name)))} END AS rule,
    CAST({_met(LIMIT)} AS BIGINT) AS n_strict, CAST({_met(1.0)} AS BIGINT) AS n_soft
  FROM split)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in RULES)}
    WHEN {LIMIT} * n_strict + n_soft >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft, CAST({LIMIT} * n_strict + n_soft AS DOUBLE) AS weight
FROM ruled
"""
