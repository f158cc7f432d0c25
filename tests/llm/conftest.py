from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Extra columns whose names are those of results or of internals.
CLASHING = ["n_words", "kept", "id", "key1", "component_id", "n_hit", "u", "times", "c0", "shard", "copy", "place", "size", "rows"]


def words(rnd: random.Random, n: int, kinds: int = 300) -> str:
    return " ".join(f"w{rnd.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, nulls in every column, empty, white and very long texts, repeated rows."""
    rnd = random.Random(5)
    base = [words(rnd, rnd.randint(1, 90)) for _ in range(40)]
    texts = list(base)
    for t in base[:15]:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t.upper(), t + "\n" + t]
    texts += [None, "", "   \n\t ", "one", "one two", "a\r\nb\n\na", "Ünï ça Straße 中文 😀 " * 30, words(rnd, 60_000), "x" * 50_000, "# $ % " * 40, "same words again and again and again " * 30]
    rows = [(i, t, "en", f"s{i % 5}", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[4]]
    rows += [(None, base[0], "en", "s0", 1), (None, None, None, None, None), (500, base[1], None, None, None), (501, base[2], "en", None, 3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"old {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
