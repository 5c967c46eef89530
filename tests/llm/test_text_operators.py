"""Each operator on odd rows against a plain Python form of its contract."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_model, license_scan, line_dedup, near_dedup, quality_rules, secret_scan, textbuf as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{k % 977}" for k in range(20000))
ODD = [None, "", " ", "\n\n", "one", "One  two\tthree", "É é É é É é", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n \n \nX", "Straße ĳ K MIT License, mit   license", "\x00 \x1f \x7f", "漢字 漢字 🙂", LONG]


@pytest.fixture(scope="module")
def documents(spark):
    random.seed(5)
    words = ["the", "of", "gnu", "general", "public", "license", "apache", "cc", "by", "mit", "Foo", "bar#", "ÄÖ", "1.2", "!!"]
    texts = ODD + [" ".join(random.choice(words) + random.choice(["", "", "\n", ","]) for _ in range(random.randint(1, 120))) for _ in range(60)]
    rows = [(k, t, k % 2, "x") for k, t in enumerate(texts)]
    rows += [(3, texts[3], 1, "x"), (None, "null id text of some words in a row here", 0, "x"), (200, texts[20], 0, "x"), (201, texts[20], 0, "x")]
    # Extra columns with names that the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")


def pairs(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def test_words_and_windows(documents):
    texts = [t for _, t in pairs(documents)]
    for inside, pattern in ((tb.BLANK_WORD, WORD), (tb.ALNUM_WORD, ALNUM)):
        got = []
        for _, _, data, offsets in tb.groups(pa.array(texts), 500):
            w = tb.words(data, offsets, inside)
            got += [[w.text(k).decode() for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
            assert len(set(w.hashes().tolist())) == len({w.text(k) for k in range(len(w.start))})
        assert got == [pattern.findall((t or "").translate(LOWER)) for t in texts]


def test_long_words_hash_by_content():
    data = np.frombuffer(b"x" * 300 + b" " + b"x" * 300 + b" " + b"x" * 299 + b"y", np.uint8)
    h = tb.words(data, np.array([0, len(data)]), tb.BLANK_WORD).hashes()
    assert h[0] == h[1] != h[2]


def test_quality_counts(documents):
    out = quality_rules.judge(documents, [])
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out.collect()), key=str)
    want = []
    for i, t in pairs(documents):
        t = t or ""
        w = WORD.findall(t)
        at = collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, not failed))
    assert got == sorted(want, key=str)


def test_rules_are_learned_and_kept_apart(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = {k: rng.random(n) for k in quality_rules.TESTED}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.5) & (x["word_length"] > 0.6))
    rules = quality_rules.cover(x, bad, np.arange(n) % 3 == 2)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= quality_rules._covers(r, x, n)
    assert len(rules) >= 2 and (hit & ~bad).sum() <= 0.02 * n and (hit & bad).sum() >= 0.9 * bad.sum()
    assert quality_rules.cover(x, np.zeros(n, bool), np.zeros(n, bool)) == []


def test_fit_and_passed(spark):
    rng = random.Random(2)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(50)) for _ in range(60)]
    junk = [t.replace(" ", "### ") for t in clean]
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(clean + junk + [None])], "doc_id long, text string, rule string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)] + [(0, None), (None, 0)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules
    kept = quality_rules.passed(docs, rules)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert quality_rules.fit(docs, labels.limit(0)) == [] == quality_rules.fit(docs.limit(0), labels)
    assert quality_rules.passed(docs.limit(0), rules).count() == 0


def test_learned_verdicts_against_plain_python(spark):
    """The shares that rules test, and the list's verdict, on every row."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeFGH") for _ in range(rng.randint(1, 9)))
    texts = ["".join(word() + rng.choice(["", "", "#", "!!", "?", "$ $"]) * (k % 4 == 3) + rng.choice([" ", " ", "\n", "\nsame line\n"]) for _ in range(rng.randint(8, 60))) for k in range(240)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 < 3)) for k in range(240)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules
    want = {}
    for k, t in enumerate(texts):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        repeated = len({j for ks in at.values() if len(ks) > 1 for i in ks for j in range(i, i + 5)})
        chars = sum(map(len, w))
        x = {
            "symbol_share": len(re.findall(r"[#*$%&|<>]", t)) / max(1, chars), "upper_share": len(re.findall("[A-Z]", t)) / max(1, chars), "shout_share": len(re.findall("[!?]", t)) / max(1, len(w)),
            "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)), "repeat_share": repeated / max(1, len(w)), "word_length": chars / max(1, len(w)),
        }
        number = next((n for n, rule in enumerate(rules) if all((x[c.feature] >= c.threshold) if c.above else (x[c.feature] <= c.threshold) for c in rule)), None)
        want[k] = (number, len(w) >= 10 and 100 * repeated <= 20 * len(w) and number is None)
    assert {r.doc_id: (r.rule, r.kept) for r in quality_rules.judge(docs, rules).collect()} == want


def test_license_base(documents):
    phrases = [(t.label, t.words) for t in license_scan.TEMPLATES if t.base]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(documents).collect()), key=str)
    want = []
    for i, t in pairs(documents):
        w = ALNUM.findall((t or "").translate(LOWER))
        places = [(k, label) for label, p in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        want.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == sorted(want, key=str)
    assert license_scan.scan(documents.limit(0)).count() == 0


def test_license_spans_survive_small_changes(spark):
    w = next(t for t in license_scan.TEMPLATES if t.text.startswith("Permission is hereby")).words
    changed = " ".join(w[:8] + ["very"] + w[8:])
    docs = spark.createDataFrame([(1, f"so {' '.join(w)} end"), (2, changed), (3, " ".join(reversed(w)))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    assert got[1] == ("mit", 1.0) and got[2][0] == "mit" and 0.7 <= got[2][1] < 1 and got[3] == ("", 0.0)


@pytest.mark.parametrize("broadcast", [license_scan.BROADCAST_GRAMS, 0])
def test_long_templates(spark, monkeypatch, broadcast):
    monkeypatch.setattr(license_scan, "BROADCAST_GRAMS", broadcast)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(2000)]
    changed = [w if k % 10 else "x" + w for k, w in enumerate(words)]
    moved = [x for k, w in enumerate(words) for x in ([w, "more"] if k % 10 == 5 else [] if k % 100 == 99 else [w])]
    rows = [(1, "intro " + " ".join(words)), (2, " ".join(changed)), (3, " ".join(moved)), (4, " ".join(words[:900])), (5, " ".join(sorted(words)))]
    templates = (license_scan.Template("long", " ".join(words)), license_scan.Template("name", " ".join(words[3:9]), exact=True))
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    assert got[1] == ("long,name", 1.0) and got[2][0].startswith("long") and got[3][0].startswith("long") and got[4] == ("name", 1.0) and got[5] == ("", 0.0)


def test_license_texts_find_themselves(spark):
    rows = [(k, t.text, t.label) for k, t in enumerate(license_scan.TEMPLATES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    for r in license_scan.scan(docs).collect():
        assert rows[r.doc_id][2] in r.labels.split(",") and r.score == 1.0
    assert {(r.labels, r.score) for r in license_scan.scan(docs, templates=()).collect()} == {("", 0.0)}
    with pytest.raises(ValueError):
        license_scan.Template("x", "one").words


SECRETS = [
    'password: "abcd1234"', "PassWD = x", "api_key=ABCDEFGH apikey: 12345678", "token: secret: abcdefghij", "AKIA" + "A1" * 6, "AKIA" + "B" * 11, "é" * 5 + "0123456789abcdef" * 2,
    "0123456789abcdef" * 2 + "g" + "a" * 31, "ghp_" + "a1B2" * 9, "-----BEGIN RSA PRIVATE KEY-----", "token=aaaaaaaa token=bbbbbbbb", "Token: '" + "ab" * 20 + "'", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, None, "", "tok en", "🙂 secret=" + "z" * 9,
]


def base_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


@pytest.mark.parametrize("broadcast", [secret_scan.BROADCAST_IDS, 0])
def test_secrets(spark, monkeypatch, broadcast):
    monkeypatch.setattr(secret_scan, "BROADCAST_IDS", broadcast)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(SECRETS)] + [(None, SECRETS[0], 1), (0, "none here", 1)], "doc_id long, text string, kinds int")
    for r in secret_scan.scan(docs).collect():
        assert [(s.start, s.number, s.kind, s.end) for s in r.found if s.number < 3] == base_spans(r.text)
    kinds = {s.kind for r in secret_scan.scan(docs).collect() for s in r.found}
    assert {"github", "jwt", "private_key"} <= kinds
    clean = {(r.doc_id, len(r.found)): r.text for r in secret_scan.redacted(docs).collect()}
    assert clean[(10, 2)] == "[SECRET] [SECRET]" and clean[(11, 2)] == "[SECRET]'" and clean[(0, 0)] == "none here"
    assert secret_scan.scan(docs.limit(0)).count() == 0 == secret_scan.redacted(docs.limit(0)).count()


def test_trigram_queries_are_necessary():
    def met(q, text):
        if q is True or isinstance(q, str):
            return q is True or q in text
        return (all if q[0] == "and" else any)(met(x, text) for x in q[1])

    assert secret_scan.trigram_query(r"[0-9a-f]{32,}") is True
    assert secret_scan.trigram_query("ab") is True
    for pattern, text in ((r"a(bcd|efg)?h", "ah"), (r"(abc|de)fgh", "defgh"), (r"x*abcd+e", "abcddde"), (r"(?i)AbC[de]f", "abcdf"), (r"(abc)+", "abcabc"), (r"(abc|x.y)z", "xqyz")):
        assert re.search(pattern, text) and met(secret_scan.trigram_query(pattern), text.lower())
    for rule, text in ((r, t) for r in secret_scan.RULES for t in SECRETS if t and re.search(r.pattern, t)):
        assert met(secret_scan.trigram_query(rule.pattern), text.lower())


def windows(text, size=10):
    w = ALNUM.findall((text or "").translate(LOWER))
    n = min(size, len(w))
    return w, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


@pytest.mark.parametrize("rows,bits", [(decontaminate.BROADCAST_ROWS, decontaminate.SIEVE_BITS), (0, 12)])
def test_decontamination(spark, monkeypatch, rows, bits):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", bits)
    rng = random.Random(3)
    item = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(n))
    items = [(f"i{k}", item(n)) for k, n in enumerate([30, 10, 9, 3, 1, 12])] + [("i7", None), ("i8", "..."), ("i9", "Only ÄWORD"), ("i9", "again twice here")]
    texts = [None, "", item(9), items[0][1], "x " + items[1][1].upper() + " y", "only Äword", "only äword", item(300), LONG, "beta " + items[2][1] + items[3][1], items[5][1] + ". " + items[5][1]]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[4], 0)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = decontaminate.contaminated(docs, bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()), key=str)
    want = []
    for i, t in ((r.doc_id, r.text) for r in docs.collect()):
        w, _ = windows(t)
        hit, names = set(), set()
        for name, text in items:
            for win in windows(text)[1]:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        names.add(name)
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in clean.collect() if r.text) == sorted((str(r.doc_id), r.text) for r, bad in zip(docs.collect(), [x[5] for x in want]) if not bad and r.text)
    assert decontaminate.contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def components(texts, percent=75):
    sets = {}
    for i, t in texts:
        w = tuple((t or "").encode().lower().split())
        sets[i] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_of_a_hub_and_a_chain(spark):
    from tidemark.llm.components import components as found

    rng = random.Random(5)
    links = [(1000, k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2200)] + [(5000, 5000), (7, 9)]
    rng.shuffle(links)
    got = {r.node: r.component for r in found(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {k: 0 for k in [*range(1, 300), 1000]} | {k: 2000 for k in range(2001, 2201)}
    assert found(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " ", "one", "One", "a b c d", "A  b\nC d", "a b c d e"]
    for n, copies, edits in ((200, 30, 3), (60, 12, 2), (400, 8, 14), (120, 40, 5)):
        base = fresh(n)
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(n)] = rng.choice(["the", "of", "et", f"w{rng.randrange(9000)}"])
            texts.append(" ".join(w))
    passage = fresh(30)
    texts += [" ".join(fresh(25) + passage) for _ in range(25)] + [" ".join(fresh(80)) for _ in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, None) for i, t in rows], "doc_id long, text string, id int, bands string").repartition(5)
    want = components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_dedup.near_duplicates(docs).collect())


def test_near_duplicates_residual_step(spark, monkeypatch):
    """A chain of copies in which no member is near all others, met in tiny blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base[4 * k : 4 * k + 70]) for k in range(18)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == want


def test_large_bands_are_not_copied(spark, monkeypatch):
    """9,000 members of one band, far from each other but for a few: each is written once, and all pairs of blocks are compared."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2000)
    rng, n, far = np.random.default_rng(2), 9000, 200
    fine = rng.integers(0, 1 << 62, (n, near_dedup.FINE_WORDS))
    near = [(int(a), int(b)) for a, b in rng.permutation(n)[: 2 * far].reshape(-1, 2)]
    for a, b in near:
        fine[b] = fine[a]
    bands = rng.integers(0, 1 << 62, (n, near_dedup.BANDS))
    bands[:, 3] = 77
    t = pa.table({"band": pa.array(np.full(n, 77)), "id": pa.array(np.arange(n)), "component": pa.array(np.where(np.arange(n) % 3 == 0, 5, np.arange(n))), "major": pa.array(np.full(n, 5)), "n": pa.array(np.full(n, 100)), "common": pa.array(np.full(n, 100)), "fine": near_dedup._lists(fine), "bands": near_dedup._lists(bands)})
    written = {}
    kept = near_dedup.shared.written
    monkeypatch.setattr(near_dedup.shared, "written", lambda df, kind: written.setdefault(kind, kept(df, kind)))
    got = sorted((r.a, r.b) for r in near_dedup._met(spark.createDataFrame(t), 2000, 75).collect())
    assert got == sorted({(min(p), max(p)) for p in near if p[0] % 3 or p[1] % 3})
    assert written["members"][0].count() == n and written["block-list"][0].count() <= 6


def test_near_duplicates_null_and_repeated_ids(spark):
    long = " ".join(f"v{k}" for k in range(40))
    docs = spark.createDataFrame([(5, long), (5, "some other text of more than five words"), (7, long), (9, "some other text of more than five words"), (None, long)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (None, None, True)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    line = "this line has nine words in it all told"
    docs = spark.createDataFrame([(2, f"head\n{line.upper()}\ntail"), (1, f"{line}\nmid\n  {line}"), (3, None), (4, ""), (None, line), (5, "short\nshort"), (1, f"again\n{line}")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in line_dedup.deduplicated(docs).collect()), key=str)
    n = len(line)
    want = [(2, "head\ntail", [(1, 5, 5 + n)]), (1, f"{line}\nmid", [(2, n + 5, 2 * n + 7)]), (3, "", []), (4, "", []), (None, "", [(0, 0, n)]), (5, "short", [(1, 6, 11)]), (1, f"again\n{line}", [])]
    assert got == sorted(want, key=str)
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_decontaminate_items_without_id(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five six"), (3, "clean")], "doc_id long, text string")
    for items, want in [([(None, "one two three"), ("a", "four five six"), (None, "four five six")], [(1, 3, [], True), (2, 3, ["a"], True), (3, 0, [], False)]), ([(None, "one two three")], [(1, 3, [], True), (2, 0, [], False), (3, 0, [], False)])]:
        bench = spark.createDataFrame(items, "item_id string, text string")
        got = decontaminate.contaminated(docs, bench).collect()
        assert sorted((r.doc_id, r.n_hit, r["items"], r.contaminated) for r in got) == want
        assert all(r.n_items == len(r["items"]) for r in got)


def test_passages_keep_no_short_lines(spark):
    docs = spark.createDataFrame([(1, "all rights reserved.\nown one\n\n"), (2, "own two\nAll  rights reserved.\n\n"), (3, "short\nshort"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in line_dedup.deduplicated(docs).collect()}
    assert got == {1: ("all rights reserved.\nown one\n\n", []), 2: ("own two\n\n", [(1, 8, 29)]), 3: ("short", [(1, 6, 11)]), 4: ("", []), 5: ("", [])}


def test_passages_within_lines(spark):
    """A passage that begins and ends inside lines goes, but for the sentences that it only shares in part."""
    inner = "That one too. It has a longer sentence of some words. So it ends."
    rows = [(1, f"Some first words {inner[:13]}\n{inner[14:]} And 🙂 more"), (2, f"🙂 Before it. {inner[:13]} {inner[14:]} After it."), (3, "Alone. So it ends. Alone again."), (4, f"Own.\n{inner[14:]}\nOwn too.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in line_dedup.deduplicated(docs).collect()}
    assert got[1] == (rows[0][1], []) and got[3] == (rows[2][1], [])  # three words recur by chance
    start = rows[1][1].index("It has")
    assert got[2][0] == "🙂 Before it. That one too. After it."
    middle, end = rows[1][1].index("So it"), rows[1][1].index("After")
    assert got[2][1] == [(0, start, middle), (0, middle, end)]
    assert got[4][0] == "Own.\nOwn too."
    # The kept copy has the passage too.
    assert {r.doc_id: r.n_passage for r in line_dedup.deduplicated(docs).collect()} == {1: 11, 2: 11, 3: 3, 4: 11}
    assert {r.doc_id for r in line_dedup.deduplicated(docs, passage_words=11).filter("repeated").collect()} == {1, 2, 4}


def test_repeated_lines_of_a_very_long_text_with_clashing_columns(spark):
    long = "\n".join(f"Line number {k % 700} of it. And {k % 700} more" for k in range(5000))
    docs = spark.createDataFrame([(1, long, 1, "a"), (2, long, 2, "b"), (2, long, 3, "c"), (3, "\r\n.\x00 !\n", 4, "d")], "doc_id long, text string, rank int, units string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.repeated, len(r.text)) for r in line_dedup.deduplicated(docs).collect())
    kept = len("\n".join(long.split("\n")[:700]))
    assert got == [(1, 5000, 4300, True, kept), (2, 5000, 5000, True, 0), (2, 5000, 5000, True, 0), (3, 3, 0, False, 7)]
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_a_shard_of_grams_by_brute_force(tmp_path):
    """Contexts of one word and of hundreds, counts of one and of thousands, numbers of two and of three bytes."""
    rng = np.random.default_rng(3)
    for types in (50_000, 3_000_000):
        sizes = rng.choice([1, 1, 1, 2, 5, 9, 254, 255, 256, 700], 900)
        keys = np.sort(rng.choice(1 << 40, len(sizes), replace=False)).astype(np.uint64)
        words = [np.sort(rng.choice(types, k, replace=False)).astype(np.uint32) for k in sizes]
        n = rng.choice([1, 1, 2, 3, 254, 255, 70_000], sizes.sum())
        language_model.Grams.write(f"file://{tmp_path}", f"g{types}", np.repeat(keys, sizes), np.concatenate(words), n)
        g = language_model.Grams(language_model.shared.mapped(f"file://{tmp_path}", f"g{types}"))
        asked = np.sort(np.concatenate([keys[::3], keys[::7] + np.uint64(1)]))
        place = g.find(asked)
        assert (place >= 0).tolist() == np.isin(asked, keys).tolist()
        place = place[place >= 0]
        begin, end = g.bounds(place)
        first = np.cumsum(sizes) - sizes
        assert (begin == first[place]).all() and (end - begin == sizes[place]).all()
        of = [n[first[k] : first[k] + sizes[k]] for k in place]
        assert g.sums(place, begin, end).T.tolist() == [[x.sum(), (x == 1).sum(), (x == 2).sum(), (x >= 3).sum()] for x in of]
        for there in (True, False):
            wanted = np.array([rng.choice(words[k]) if there else types for k in place], np.uint32)
            at = g.words.search(begin, end, wanted)
            assert (at >= 0).all() == there == (at >= 0).any()
            if there:
                assert (np.concatenate(words)[at] == wanted).all() and (g.counts(at) == n[at]).all()


def test_texts_that_occur_twice(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"t{rng.randrange(40)}" for _ in range(30))
    twice, texts = text(), [text() for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate([twice, twice, *texts, ""])), "doc_id long, text string")
    grams = collections.Counter()
    for t in [twice, twice, *texts]:
        w = [0, *t.split(), None]
        grams.update(zip(w, w[1:], w[2:]))
    model = language_model.train(docs, order=3)
    for r in language_model.scored(docs, model, keep=("text",)).collect():
        w = [0, *r.text.split(), None]
        assert r.n_again == sum(grams[g] > 1 for g in zip(w, w[1:], w[2:]))


@pytest.mark.parametrize("shard", [language_model.SHARD, 40])
def test_language_model(documents, shard):
    docs = documents.select("doc_id", "text", language_model.held_out().alias("held_out"))
    model = language_model.train(docs.filter("NOT held_out"), shard_size=shard)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in language_model.scored(docs, model, keep=("held_out",)).collect()), key=str)
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t in pairs(documents)]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t in texts if not out(i)]
    c, bi = collections.Counter(w for t in train for w in t), collections.Counter(p for t in train for p in zip([0, *t[:-1]], t))
    ctx, low = collections.Counter(), collections.Counter(w for _, w in bi)
    few = collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), n in bi.items():
        ctx[v] += n
        few[v][min(n, 3) - 1] += 1
    of = lambda x: [sum(n == k for n in x.values()) for k in range(1, 5)]
    d, e = language_model.discounts(of(bi)), language_model.discounts(of(low))
    types, total = len(c), sum(low.values())
    left = sum(x * y for x, y in zip(e, [*of(low)[:2], sum(n >= 3 for n in low.values())])) / total

    def p(v, w):
        one = max(low[w] - (0, *e)[min(low[w], 3)], 0) / total + left / (types + 1)
        if v not in ctx:
            return one
        n = bi[v, w]
        return max(n - (0, *d)[min(n, 3)], 0) / ctx[v] + sum(x * y for x, y in zip(d, few[v])) / ctx[v] * one

    assert sum(p(b"the", w) for w in c) + p(b"the", "new") == pytest.approx(1)
    tokens = sum(c.values())
    want = [(i, out(i), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (tokens + types + 1)) for w in t), 6), round(sum(math.log10(p(v, w)) for v, w in zip([0, *t[:-1]], t)), 6)) for i, t in texts]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("order, shard", [(3, language_model.SHARD), (3, 40), (4, 40)])
def test_language_model_of_higher_order(documents, order, shard):
    docs = documents.select("doc_id", "text", language_model.held_out().alias("held_out"))
    model = language_model.train(docs.filter("NOT held_out"), shard_size=shard, order=order)
    got = sorted(((r.doc_id, round(r.score, 6)) for r in language_model.scored(docs, model).collect()), key=str)
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t in pairs(documents)]
    train = [t for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    grams = {k: collections.Counter() for k in range(1, order + 1)}
    for t in train:
        t = [0, *t]
        for k in range(1, len(t)):
            g = tuple(t[max(0, k - order + 1) : k + 1])
            grams[len(g)][g] += 1
    for k in range(order, 1, -1):
        grams[k - 1].update(g[1:] for g in grams[k])
    types = len({w for t in train for w in t})
    d, ctx, few = {}, collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for k, c in grams.items():
        d[k] = language_model.discounts([sum(n == j for n in c.values()) for j in range(1, 5)])
        for g, n in c.items():
            ctx[g[:-1]] += n
            few[g[:-1]][min(n, 3) - 1] += 1

    def p(v, w):
        k = len(v) + 1
        low = p(v[1:], w) if v else 1 / (types + 1)
        if v not in ctx:
            return low
        n = grams[k][*v, w]
        return max(n - (0, *d[k])[min(n, 3)], 0) / ctx[v] + sum(x * y for x, y in zip(d[k], few[v])) / ctx[v] * low

    words = {w for t in train for w in t}
    assert max(len(v) for v in ctx) == order - 1
    for v in [(0,), *sorted((v for v in ctx if len(v) == order - 1), key=str)[:3]]:
        assert sum(p(v, w) for w in words) + p(v, "new") == pytest.approx(1)
    want = [(i, round(sum(math.log10(p(tuple([0, *t][max(0, k - order + 2) : k + 1]), w)) for k, w in enumerate(t)), 6)) for i, t in texts]
    assert got == sorted(want, key=str)


def test_language_model_query_sees_two_words_back():
    assert language_model.ORDER >= 3


def test_language_model_without_training(documents):
    model = language_model.train(documents.limit(0))
    assert all(r.score == 0 and r.n_known == 0 for r in language_model.scored(documents, model).collect())
