"""The filter audit against a count of every document in every order of the filters."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def failed(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        x
        for x, fails in zip(
            "ABCD", (len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))), strict=True
        )
        if fails
    }


def expected(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = [(r[2] or "", failed(r[1] or "") | ({"E"} if r[0] is not None and r[0] > first[r[1] or ""] else set()), r[0] in good, r[0] in toxic) for r in rows]
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        of_part = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                live = [d for d in of_part if not d[1] & set(order[: step - 1])]
                gone = [d for d in live if x in d[1]]
                n_fails = sum(x in d[1] for d in of_part)
                shapley[part, x] += len(gone)
                out[part, order, step] = [len(live) - len(gone), len(gone), n_fails - len(gone), sum(d[1] == {x} for d in of_part), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


@pytest.fixture(scope="module")
def labels(spark, corpus):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 0, 1])) for i in range(0, 110, 2)]
    rows += [(3, 0, 0), (3, 1, 0), (None, 1, 1), (99_999, 1, 1), (500, None, 1)]
    return rows, spark.createDataFrame(rows, LABELS).withColumn("part", F.lit("old"))


def found(df):
    return sorted(map(tuple, df.collect()))


def test_every_order_counted(spark, docs, corpus, labels):
    assert found(audit.audit(docs, labels[1])) == expected(corpus, labels[0])


def test_parts_with_null_and_many_values(spark, corpus, labels):
    rows = [(r[0], r[1], None if i % 7 == 0 else f"p{i % 40}", r[3], r[4]) for i, r in enumerate(corpus)]
    assert found(audit.audit(spark.createDataFrame(rows, DOCS), labels[1])) == expected(rows, labels[0])


def test_clashing_columns_and_empty_tables(spark, clashing, no_docs, corpus, labels):
    more = clashing.select("*", *[F.lit("old").alias(c) for c in ("part", "failed", "digest", "first", "good", "toxic", "survivors", "labelled")])
    assert found(audit.audit(more, labels[1])) == expected(corpus, labels[0])
    none = spark.createDataFrame([], LABELS)
    assert found(audit.audit(no_docs, none)) == []
    assert found(audit.audit(clashing, none)) == expected(corpus, [])


def test_carry_save_counts_bits():
    rnd = np.random.default_rng(4)
    for n, groups in ((0, 3), (1, 1), (5000, 1), (777, 30), (64, 64)):
        words, group = rnd.integers(0, 1 << 32, n, dtype=np.uint32), rnd.integers(0, groups, n)
        plain = np.zeros((groups, 32), np.int64)
        for w, g in zip(words.tolist(), group.tolist(), strict=True):
            plain[g] += [(w >> b) & 1 for b in range(32)]
        assert (audit.popcounts(words, group, groups) == plain).all()


def test_survival_words():
    for subset in range(32):
        for fails in range(32):
            assert bool(int(audit.SURVIVAL[fails]) >> subset & 1) == (subset & fails == 0)
