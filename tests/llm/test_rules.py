"""Operators 1, 2 and 6 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from arledger.llm import common, decontamination, linededup, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_rules(text: str | None, rules: repetition.Rules):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - rules.min_words + 1):
        at[tuple(w[i : i + rules.min_words])].append(i)
    covered, longest = set(), 0
    for places in at.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + rules.min_words))
            if len(w) < 3000:
                for a in places:
                    for b in places:
                        if a < b:
                            n = 0
                            while b + n < len(w) and w[a + n] == w[b + n]:
                                n += 1
                            longest = max(longest, n)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < rules.least_words or 100 * len(covered) > rules.percent_covered * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), longest, failed, not failed and longest <= rules.longest_words


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed", "kept"]


@pytest.mark.parametrize("min_words", [1, 2, 3, 5, 8])
def test_suffix_arrays_match_brute_force(min_words):
    rnd = random.Random(min_words)
    rules = repetition.Rules(min_words=min_words, longest_words=12)
    texts = ["", None, "a", "a a a a a a a a a a a a a a a a a a a a a a a", "\n\n", "x y\nx y\nz"]
    for _ in range(250):
        n, kinds = rnd.randint(0, 60), rnd.choice([1, 2, 5, 40])
        texts.append("".join(f"{rnd.choice('abç#')}{rnd.randrange(kinds)}{rnd.choice([' ', ' ', '  ', chr(10), chr(9), chr(0xA0)])}" for _ in range(n)))
    got = repetition.measure([t.encode() if t is not None else None for t in texts], rules)
    assert [tuple(got[f][i].item() for f in FIELDS) for i in range(len(texts))] == [brute_rules(t, rules) for t in texts]


def test_rules_over_all_rows(docs, corpus):
    rules = repetition.Rules()
    got = sorted((tuple(r[f] for f in ["doc_id", *FIELDS]) for r in repetition.repetition(docs).collect()), key=repr)
    long = [r for r in corpus if r[1] and len(r[1]) > 100_000]
    assert len(long) == 1 and len(got) == len(corpus)
    want = {(r[0], r[1]): brute_rules(r[1], rules) for r in corpus}
    assert got == sorted(((r[0], *want[(r[0], r[1])]) for r in corpus), key=repr)


def test_kept_rows_have_their_columns(clashing, corpus, no_docs):
    rules = repetition.Rules()
    kept = repetition.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r[0], r[1]) for r in kept.collect() if r[0] is not None) == sorted((r[0], r[1]) for r in corpus if r[0] is not None and brute_rules(r[1], rules)[-1])
    assert repetition.keep_good(no_docs).count() == 0 and repetition.repetition(no_docs).count() == 0


def brute_hits(text: str | None, items: list[tuple], window: int = 10):
    w = ALNUM.findall(lower(text or ""))
    windows = defaultdict(set)
    for key, t in items:
        x = ALNUM.findall(lower(t or ""))
        for i in range(max(1, len(x) - window + 1) if x else 0):
            windows[tuple(x[i : i + window])].add("" if key is None else str(key))
    hit, found = set(), set()
    for n in {len(g) for g in windows}:
        for i in range(len(w) - n + 1):
            if (g := tuple(w[i : i + n])) in windows:
                hit.update(range(i, i + n))
                found |= windows[g]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(7, "w1 w2 w3"), (8, None), (9, "..."), (None, "changed"), (10, "w5"), (11, "One, TWO"), (11, "ünï ça"), (12, "x" * 50_000)]


@pytest.fixture(scope="session")
def benchmark(spark, corpus):
    rows = [*ITEMS, *[(100 + i, f"start {r[1][: 120 + 40 * i]} end") for i, r in enumerate(corpus[:12])], (101, corpus[20][1]), (101, corpus[20][1])]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def test_wu_manber_over_all_rows(docs, corpus, benchmark):
    found = decontamination.digest(decontamination.hits(docs, benchmark[0]))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(((r[0], *brute_hits(r[1], benchmark[1])) for r in corpus), key=repr)


def test_wu_manber_in_several_blocks(docs, benchmark, monkeypatch):
    one = decontamination.digest(decontamination.hits(docs, benchmark[0])).collect()
    clean = decontamination.keep_clean(docs, benchmark[0]).collect()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 12_000)
    assert sorted(decontamination.digest(decontamination.hits(docs, benchmark[0])).collect(), key=repr) == sorted(one, key=repr)
    assert sorted(decontamination.keep_clean(docs, benchmark[0]).collect(), key=repr) == sorted(clean, key=repr)


def test_clean_rows_have_their_columns(clashing, corpus, benchmark, no_docs):
    kept = decontamination.keep_clean(clashing, benchmark[0])
    assert kept.columns == clashing.columns
    assert sorted(repr(r[:2]) for r in kept.collect()) == sorted(repr(r[:2]) for r in corpus if not brute_hits(r[1], benchmark[1])[-1])
    nothing = benchmark[0].limit(0)
    assert decontamination.keep_clean(clashing, nothing).count() == len(corpus)
    assert decontamination.digest(decontamination.hits(no_docs, benchmark[0])).count() == 0


def test_wu_manber_random():
    rnd = random.Random(3)
    for window in (1, 2, 10):
        items = [(i, " ".join(rnd.choice(["a", "bb", "ccc", "ß", "d1"]) for _ in range(rnd.randint(0, 14)))) for i in range(30)]
        texts = ["".join(rnd.choice(["a", "BB", "ccc", "ß", "D1", "zz"]) + rnd.choice([" ", "-", "\n", ", "]) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
        patterns = decontamination.Patterns([(str(i), t.encode()) for i, t in items], window)
        n, ranges, found = patterns.found([t.encode() for t in texts])
        for k, t in enumerate(texts):
            want = brute_hits(t, items, window)
            assert (n[k], sum(b - a for a, b in ranges[k]), len(found[k])) == want[:3]


def brute_lines(rows):
    keys, out = defaultdict(set), []
    of = lambda line: lower(line.strip("\x20\t\n\x0b\x0c\r"))
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[0] is not None and len(of(line)) >= 10:
                keys[of(line)].add(r[0])
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or len(of(x)) < 10 or len(keys[of(x)]) < 2 or min(keys[of(x)]) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_over_all_rows(spark, corpus, clashing, no_docs):
    rnd = random.Random(8)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["short", "", "  Padded Line of Some Length \r", "padded line of some length", "é" * 10, "é" * 9]
    rows = [*corpus, *[(1000 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8))), "en", "s", 1) for i in range(150)]]
    docs = spark.createDataFrame(rows, clashing.schema.fieldNames()[:5] and "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = linededup.line_dedup(docs, with_text=True)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_lines(rows)
    assert sorted((tuple(r) for r in linededup.line_dedup(clashing).collect()), key=repr) == [x[:4] for x in brute_lines(corpus)]
    assert linededup.line_dedup(no_docs).count() == 0


def test_full_filters_change_nothing(docs, corpus, monkeypatch):
    monkeypatch.setattr(linededup, "LEAST_BITS", 5)
    monkeypatch.setattr(linededup, "MOST_BITS", 5)
    assert sorted((tuple(r) for r in linededup.line_dedup(docs).collect()), key=repr) == [x[:4] for x in brute_lines(corpus)]


def test_filters_have_no_false_negatives():
    import numpy as np

    hashes = common.mix64(np.arange(5000))
    filters = linededup.Filters(16)
    filters.add(hashes[:3000])
    filters.add(hashes[2000:])
    assert linededup.seen_twice(filters.once, 16, hashes).all()
    assert linededup.seen_twice(filters.twice, 16, hashes[2000:3000]).all()
    assert linededup.seen_twice(filters.twice, 16, hashes[:2000]).mean() < 0.3
