"""The factorization machine: held-out accuracy, interactions, and equality with a plain recomputation."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def auc(pairs):
    good, bad = [s for s, y in pairs if not y], [s for s, y in pairs if y]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels)
    assert scored.count() == docs.count() and scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    hits, called = sum(r.predicted and r.toxic for r in rows), sum(r.predicted for r in rows)
    assert auc([(r.score, r.toxic) for r in rows]) > 0.93
    assert hits / called > 0.95 and hits / sum(r.toxic for r in rows) > 0.8


def mixed(rnd, insult, group):
    words = [f"w{rnd.randrange(400)}" for _ in range(40)]
    return " ".join(words + ["dolt"] * insult + ["lakefolk"] * group)


def test_pairs_beyond_the_sum_of_words(spark):
    """Toxic is only the insult beside the group: no additive weights separate all four cases so well."""
    rnd, rows, labels = random.Random(1), [], []
    for i in range(4000):
        insult, group = rnd.random() < 0.4, rnd.random() < 0.4
        rows.append((i, mixed(rnd, insult, group), "en", "s", 0))
        labels.append((i, 1, int(insult and group)))
    machine = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    both, insult, group, none = (machine.scores([mixed(rnd, a, b).encode()])[0] for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert both > 0.9 and max(insult, group, none) < 0.1
    at = [int(machine.inputs([w.encode()])[1][0]) for w in ("dolt", "lakefolk")]
    assert machine.v[at[0]] @ machine.v[at[1]] > 0


def plain_terms(text):
    out, word = set(), ""
    for ch in text + " ":
        if ch.isascii() and not ch.isalnum():
            if word:
                out |= {("word", word)} | {("stem", word[:k]) for k in toxicity.STEMS if len(word) >= k}
            word = ""
        else:
            word += ch.lower() if ch.isascii() or ch in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ" else ch
    return out


def test_terms_and_margins_by_hand(corpus):
    texts = [t.encode() if t is not None else None for _, t, *_ in corpus]
    row, found = toxicity.terms(texts)
    assert [len(plain_terms(t or "")) for _, t, *_ in corpus] == np.bincount(row, minlength=len(texts)).tolist()
    rnd = np.random.default_rng(3)
    hashes = np.sort(rnd.choice(np.unique(found), 60, replace=False))
    machine = toxicity.Machine(hashes, -0.3, rnd.normal(0, 1, 60), rnd.normal(0, 0.3, (60, toxicity.FACTORS)))
    scores = toxicity.Machine.loaded(machine.dumped()).scores(texts)
    for i in range(len(texts)):
        mine = np.flatnonzero(np.isin(hashes, found[row == i]))
        margin = machine.w0 + machine.w[mine].sum() + sum(machine.v[a] @ machine.v[b] for a in mine for b in mine if a < b)
        assert math.isclose(scores[i], 1 / (1 + math.exp(-margin)), rel_tol=1e-9)


def test_odd_rows(spark, docs, clashing, no_docs, corpus):
    rnd = random.Random(6)
    labels = [(i, 1, int(rnd.random() < 0.3)) for i in range(100)] + [(None, 1, 1), (5, 1, None), (7, 0, 1), (99_999, 0, 1)]
    labels = spark.createDataFrame(labels, LABELS)
    scored = toxicity.toxicity(docs, labels)
    rows = scored.collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
    again = toxicity.toxicity(clashing.select("*", *[F.lit("x").alias(c) for c in ("toxic", "score", "term", "terms", "n")]).repartition(4), labels).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    by_text = {}
    for r, (i, text, *_) in ((r, c) for r in rows for c in corpus if r.doc_id == c[0] and r.doc_id is not None):
        by_text.setdefault(text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.toxicity(no_docs, labels).count() == 0


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_one_label_only(spark, docs, toxic):
    labels = spark.createDataFrame([] if toxic is None else [(i, 1, toxic) for i in range(50)], LABELS)
    scores = {r.score for r in toxicity.toxicity(docs, labels).select("score").distinct().collect()}
    assert len(scores) == 1 and (scores.pop() > 0.9) == (toxic == 1)


def test_held_out_labels_teach_nothing(spark, docs):
    labels = [(i, 1, i % 2) for i in range(100)]
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (toxicity.toxicity(docs, spark.createDataFrame(x, LABELS)).collect() for x in (labels, flipped))
    assert sorted(map(repr, one)) == sorted(map(repr, two))
