"""Operators 7 and 8 against the tokenizers' libraries."""

from __future__ import annotations

import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arledger.llm import packing, prefixcounts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = 50256
ODD = ["", " ", "  ", "\n", "\n\n  a b\tc \n", "▁", " ▁ x", "中文字符 ﷺ 😀😀 ñandú", "<s> </s> <unk> <0x0A>", "a\x00b", "   lead", "trail   ", "é ﬁ Å", "x" * 3000, "the" * 400 + " " * 40 + "\n" * 30, "﻿bom", "　wide", "a\r\nb"]


@pytest.fixture(scope="module")
def model():
    return prefixcounts.pieces(PIECES)


def odd_texts(n):
    rnd = random.Random(n)
    alphabet = " \n\t▁aetho<s>0x9éß中😀.,-  thing"
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 70))) for _ in range(n)]


def test_counts_are_the_librarys(model):
    texts = odd_texts(2000)
    assert prefixcounts.counts(model, [t.encode() for t in texts]).tolist() == [len(x) for x in model.library.encode(texts)]


def test_every_prefix_is_exact(model):
    for t in odd_texts(60):
        t = t[:250]
        assert prefixcounts.table(model, t).tolist() == [len(model.library.encode(t[:k])) for k in range(len(t) + 1)]


def without_spaces(n):
    rnd = random.Random(n)
    han = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都"
    return {
        "base64": base64.b64encode(rnd.randbytes(n)).decode(), "hex": rnd.randbytes(n // 2).hex(), "chinese": "".join(rnd.choice(han) for _ in range(n // 3)),
        "rare": "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(n // 3)), "thai": "".join(chr(rnd.randrange(0xE01, 0xE2E)) for _ in range(n // 3)),
        "one letter": "a" * n, "letters": "".join(rnd.choice("etaoinshrdlu") for _ in range(n)), "words": "".join(rnd.choice(["the", "and", "house", "quick", "number"]) for _ in range(n // 5)),
        "code": "".join(rnd.choice(["function", "(a,b){", "return", "=;", "i++", ".push(", "null", "!==", "};"]) for _ in range(n // 5)), "mixed": "".join(rnd.choice("aé中😀ß1_-eth") for _ in range(n)),
    }


@pytest.mark.parametrize("kind", sorted(without_spaces(9)))
def test_long_runs_without_spaces(model, kind):
    text = without_spaces(6000)[kind]
    texts = [text, "lead " + text, text + "\n" + text[: len(text) // 2], text[:40], text[:33], text[:32]]
    assert prefixcounts.counts(model, [t.encode() for t in texts]).tolist() == [len(x) for x in model.library.encode(texts)]
    part = text[:300]
    assert prefixcounts.table(model, part).tolist() == [len(model.library.encode(part[:k])) for k in range(len(part) + 1)]


def test_crowds_of_long_parts(model, monkeypatch):
    monkeypatch.setattr(prefixcounts, "CROWD", 2)
    texts = [t[:n] for t in without_spaces(1500).values() for n in (400, 900, 1500)]
    assert prefixcounts.counts(model, [t.encode() for t in texts]).tolist() == [len(x) for x in model.library.encode(texts)]


def test_a_megabyte_without_spaces(model):
    for kind in ("base64", "chinese", "hex"):
        text = without_spaces(1_000_000)[kind].encode()
        began = time.process_time()
        prefixcounts.counts(model, [text])
        assert time.process_time() - began < 4  # seconds; well under one on a free machine


def test_forgotten_pairs_change_nothing(model):
    texts = [t.encode() for t in odd_texts(300)]
    want = prefixcounts.counts(model, texts).tolist()
    model.pairs[:] = 0
    assert prefixcounts.counts(model, texts).tolist() == want


def test_counts_over_all_rows(spark, docs, corpus, no_docs, model):
    found = prefixcounts.token_counts(docs, PIECES, 100).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(model.library.encode(r[1] or "")), n > 100) for r in corpus]
    assert sorted((tuple(r) for r in found), key=repr) == sorted(want, key=repr)
    assert prefixcounts.token_counts(no_docs, PIECES, 100).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: r[2] for r in prefixcounts.token_counts(real, PIECES, 4096).collect()}
    rows = real.collect()
    assert got == {r["doc_id"]: len(model.library.encode(r["text"] or "")) for r in rows}


def test_questions_need_no_encoding(docs, corpus, model):
    short = docs.where("length(text) < 2000 or text is null")
    tables = prefixcounts.prefix_tables(short.select("doc_id", "text"), PIECES)
    asked = tables.select("doc_id", prefixcounts.tokens_of_prefix(F.col("prefix_counts"), F.lit(17)).alias("of17"), prefixcounts.longest_prefix(F.col("prefix_counts"), F.lit(12)).alias("within12"))
    texts = {r[0]: r[1] or "" for r in corpus if r[0] is not None}
    for r in asked.where("doc_id is not null").collect():
        t = texts[r["doc_id"]]
        assert r["of17"] == len(model.library.encode(t[:17]))
        assert r["within12"] == max(k for k in range(len(t) + 1) if len(model.library.encode(t[:k])) <= 12)


def test_best_fit_takes_the_tightest_row():
    rnd = random.Random(0)
    for width in (1, 2, 7, 64, 100, 4096):
        for _ in range(40):
            lengths = [rnd.randint(1, width) for _ in range(rnd.randint(0, 60))]
            free: list[int] = []
            for n in sorted(lengths, reverse=True):
                fit = [f for f in free if f >= n]
                if fit:
                    free.remove(min(fit))
                    free.append(min(fit) - n)
                else:
                    free.append(width - n)
            rows = packing.best_fit_decreasing(np.array(lengths, np.int64), width)
            assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
            assert sorted(width - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def unpacked(found, width):
    """All documents' ids, put together again from the matrices."""
    parts: dict = {}
    for m in found:
        ids = np.frombuffer(m["ids"], "<u2").reshape(m["n_rows"], width)
        for r in range(m["n_rows"]):
            cuts = m["cu_seqlens"][r]
            assert cuts[0] == 0 and cuts == sorted(cuts) and cuts[-1] <= width and cuts[:-1] == m["position_resets"][r]
            assert (ids[r, cuts[-1] :] == END).all()
            places = packing.position_ids(cuts, width)
            for a, b, d, at in zip(cuts, cuts[1:], m["doc_ids"][r], m["token_starts"][r], strict=False):
                assert places[a:b].tolist() == list(range(b - a))
                parts.setdefault(d, []).append((at, ids[r, a:b].tolist()))
    return parts


def test_packing_is_lossless(docs, corpus, no_docs, tmp_dir, spark):
    encode = packing.encoder(BYTES, public_tokenizers.PATTERN)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.pack(unique, BYTES, public_tokenizers.PATTERN, END, width=128)
    packing.write(packed, f"{tmp_dir}/packed")
    found = spark.read.parquet(f"{tmp_dir}/packed").collect()
    parts = unpacked(found, 128)
    want = {r[0]: encode.encode_ordinary(r[1]) + [END] for r in corpus if r[0] is not None and r[1]}
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in parts.items()} == want
    assert all(at % 128 == 0 for p in parts.values() for at, _ in p)
    assert sum(m["n_tokens"] for m in found) == sum(map(len, want.values()))
    assert len({m["matrix"] for m in found}) == len(found)
    assert packing.pack(no_docs, BYTES, public_tokenizers.PATTERN, END).count() == 0


def test_small_groups_pack_everything_too(docs, corpus, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 500)
    found = packing.pack(docs, BYTES, public_tokenizers.PATTERN, END, width=64).collect()
    encode = packing.encoder(BYTES, public_tokenizers.PATTERN)
    assert sum(m["n_tokens"] for m in found) == sum(len(encode.encode_ordinary(r[1])) + 1 for r in corpus if r[1])
