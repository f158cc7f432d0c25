"""Operator 4 against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from arledger.llm import graph, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(a, b, percent=90):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def brute_components(rows, percent=90, n=3):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], set()).add(shingle_set(r[1], n))
    ids = sorted(sets)
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(linked(x, y, percent) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: root(i) for i in ids}


def near_copies(seed, groups=12, most=60):
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([4, 9, 12, 14, 22, 35, 60, 130, 400]))]
        for _ in range(rnd.randint(1, most)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rnd.randrange(len(w))
                kind = rnd.random()
                if kind < 0.5:
                    w[at] = f"v{rnd.randrange(10**6)}"
                elif kind < 0.75:
                    w.insert(at, f"v{rnd.randrange(10**6)}")
                elif len(w) > 1:
                    del w[at]
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_filing_misses_no_link(percent):
    scheme = jaccard.Scheme(percent)
    rnd = random.Random(percent)
    for size in [1, 2, 3, 4, 5, 7, 9, 10, 12, 14, 15, 17, 19, 20, 21, 22, 25, 32, 33, 40, 48, 49, 60, 73, 90, 108, 109, 150, 240]:
        for _ in range(12):
            a = set(rnd.getrandbits(64) for _ in range(size))
            b = set(a)
            while True:
                c = set(b)
                if rnd.random() < 0.5:
                    c.discard(rnd.choice(sorted(c)))
                else:
                    c.add(rnd.getrandbits(64))
                if not linked(a, c, percent):
                    break
                b = c
            if a == b:
                continue
            h = np.array(sorted(a) + sorted(b), np.uint64)
            sig, who, level, need = jaccard.signatures(h, np.array([len(a), len(b)]), scheme)
            met = set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
            target = max(level[(who == w)].min() for w in (0, 1))  # the class of the larger set
            wanted = [int(need[(who == w) & (level == target)][0]) for w in (0, 1)]
            in_class = met & set(sig[level == target].tolist())
            assert len(in_class) >= max(1, *wanted), (len(a), len(b), len(met), wanted)


def test_tree_bounds_lose_nothing():
    rnd = random.Random(2)
    for percent in (60, 90):
        texts = [t for _, t in near_copies(4, 8, 40)]
        sets = sorted({shingle_set(t) for t in texts if shingle_set(t)}, key=sorted)
        number = {s: rnd.getrandbits(64) for x in sets for s in x}
        arrays = [np.array(sorted(number[s] for s in x), np.uint64) for x in sets]
        label = list(range(len(sets)))
        for a, b in jaccard.spanning_links(arrays, percent):
            assert linked(sets[a], sets[b], percent)
            label = [label[a] if x == label[b] else x for x in label]
        for a in range(len(sets)):
            for b in range(a):
                assert not linked(sets[a], sets[b], percent) or label[a] == label[b]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_components_match_all_pairs(spark, seed, n, percent):
    rows = near_copies(seed)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, percent)
    want = brute_components(rows, percent, n)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == {i: (len(shingle_set(t, n)), want[i]) for i, t in rows}


def test_large_components_are_dealt_to_blocks(spark, monkeypatch):
    rows = near_copies(3, 3, 120)
    monkeypatch.setattr(jaccard, "UNDIVIDED", 500)
    monkeypatch.setattr(jaccard, "BLOCK_UNIT", 300)
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", 4_000)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90)
    want = brute_components(rows)
    assert {r[0]: r[2] for r in found.collect()} == want


def test_all_rows(docs, corpus, no_docs, spark):
    found = jaccard.jaccard_components(docs, 3, 90).collect()
    want = brute_components(corpus)
    assert sorted((tuple(r) for r in found), key=repr) == sorted(((r[0], len(shingle_set(r[1])), want.get(r[0])) for r in corpus), key=repr)
    assert jaccard.jaccard_components(no_docs).count() == 0
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    assert {r[0] for r in jaccard.jaccard_components(named).collect()} == {None if r[0] is None else str(r[0]) for r in corpus}


def test_first_of_each_group_stays(clashing, corpus):
    kept = jaccard.keep_first(clashing)
    want = brute_components(corpus, 80, 5)
    assert kept.columns == clashing.columns
    got = kept.collect()
    assert sorted(r[0] for r in got if r[0] is not None) == sorted({i for i, c in want.items() if i == c})
    assert sum(r[0] is None for r in got) == sum(r[0] is None for r in corpus)


def test_graph_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            least[y] = x
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r[0]: r[1] for r in found} == {i: root(i) for i in least} and len(found) == len(least)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("small", "large", "percent"), [(8, 13, 60), (18, 28, 60), (10, 30, 33)])
def test_sets_two_size_classes_apart_meet(small, large, percent):
    h = np.random.default_rng(5).integers(1, 1 << 63, large).astype(np.uint64)
    scheme = jaccard.Scheme(percent)
    sig, who, levels, needs = jaccard.signatures(np.concatenate((np.sort(h[:small]), np.sort(h))), np.array([small, large]), scheme)
    shared = set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
    assert 100 * small >= percent * large and len(shared) >= needs[who == 1].min()


def test_linked_sets_of_8_and_13_shingles(spark):
    words = [f"w{i}" for i in range(15)]
    rows = [(1, " ".join(words[:10])), (2, " ".join(words)), (3, "other words that stand alone here")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 60).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {1: (8, 1), 2: (13, 1), 3: (4, 3)}
