"""The prefix trie of conversations: every node against sets of prefixes, at several shard sizes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.llm import turntrie

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def expected(rows, rebuild=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, tie, role, text))
    paths = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in paths}
        base = {c: c - int(np.fmod(c, 20)) for c in paths}
        paths = {c: paths.get(base[c], [])[: h[c]] + p[h[c] :] for c, p in paths.items()}
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", node[-1][1]) if w]) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), up, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    """Copies, shared and common turns, gaps, null and tied turn numbers, repeated rows, long and empty conversations."""
    rnd, rows = random.Random(3), []
    for c in [*range(0, 130), -7, -20, 1005, 40_001, 9_000_000]:
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn * 70, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "what is  it", "", None, "a\tb\nc", "ü 中文"])))
    rows += [(300 + i, t, "user", f"same {t}") for i in range(60) for t in range(6)]
    rows += [(500, None, "user", "untold"), (500, None, "user", "untold"), (500, 3, "x", "tie"), (500, 3, "y", "tie"), (500, 3, "x", "tie")]
    rows += [(700, t, "user", f"turn {t % 7}") for t in range(600)] + [(701, t, "user", f"turn {t % 7}") for t in range(590)]
    rows += [(None, 1, "user", "of nobody"), (None, None, None, None), (801, 0, "user", "only one, and the base has none")]
    return rows


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [turntrie.SHARD_TURNS, 300, 1])
def test_nodes_equal_sets_of_prefixes(spark, talks, shard_turns):
    df = spark.createDataFrame(talks, ROWS).repartition(5)
    assert found(turntrie.nodes(turntrie.rebuilt(df), shard_turns=shard_turns)) == expected(talks)


def test_plain_conversations_and_other_columns(spark, talks):
    df = spark.createDataFrame([r for r in talks if r[0] != 700 and r[0] != 701], ROWS)
    more = df.select("*", *[F.lit("old").alias(c) for c in ("conv", "pos", "digest", "words", "depth", "a", "n", "copy", "top", "size")])
    assert found(turntrie.nodes(turntrie.plain(more))) == expected([r for r in talks if r[0] not in (700, 701)], rebuild=False)


def test_short_ranges(spark, talks, monkeypatch):
    for name, value in (("RANGE", 3), ("BLOCK", 2), ("UNFOLD", 1)):
        monkeypatch.setattr(turntrie, name, value)
    assert found(turntrie.nodes(turntrie.rebuilt(spark.createDataFrame(talks, ROWS)), shard_turns=50)) == expected(talks)


def test_no_conversations(spark):
    assert found(turntrie.nodes(turntrie.rebuilt(spark.createDataFrame([], ROWS)))) == []
    assert found(turntrie.nodes(turntrie.rebuilt(spark.createDataFrame([(None, 1, "user", "x")], ROWS)))) == []


def test_turnless_conversations_make_a_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(c, 0, "user", "gone")]
    assert found(turntrie.nodes(turntrie.rebuilt(spark.createDataFrame(rows, ROWS)))) == expected(rows)
    assert expected(rows)[0][:6] == (c, 0, None, 1, 0, 1)


def test_double_array_walks_what_it_holds_and_nothing_else():
    rnd = random.Random(8)
    paths = sorted({tuple(rnd.randrange(40) for _ in range(rnd.randint(1, 6))) for _ in range(800)})
    symbols = np.array([s for p in paths for s in p])
    length = np.array([len(p) for p in paths])
    begin = np.cumsum(length) - length
    trie, states = turntrie.packed(symbols, begin, length)
    prefixes = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    assert len(set(states.tolist())) == len(prefixes) == int((trie.check[1 : trie.end] >= 0).sum())
    for p in [tuple(rnd.randrange(41) for _ in range(rnd.randint(1, 4))) for _ in range(500)] + paths[:200]:
        state = np.array([0])
        for s in p:
            state = trie.walk(state, np.array([s])) if state[0] >= 0 else state
        assert (state[0] >= 0) == (p in prefixes)
    assert trie.end < 3 * len(prefixes)
