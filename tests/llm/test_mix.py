"""Operators 3, 5, 9 and 10 and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arledger.llm import chat, jaccard, langid, mixing, sharding



def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = math.floor((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def key_of(doc_id) -> int:
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def test_shards_are_jump_hashes(docs, corpus, no_docs, clashing):
    found = sharding.slots(docs, 7).collect()
    slots = defaultdict(list)
    for r in found:
        assert r["shard"] == jump(key_of(r["doc_id"]), 7) and r["grown_shard"] == jump(key_of(r["doc_id"]), 8) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 7)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert sharding.slots(no_docs, 7).count() == 0
    placed = sharding.assign(clashing, 7)
    assert placed.columns == [c for c in clashing.columns if c != "shard"] + ["shard"]
    assert all(r["shard"] == jump(key_of(r["doc_id"]), 7) for r in placed.collect())


def test_shards_grow_little_and_stay_even(spark):
    rows = spark.range(40_000).withColumn("text", F.lit("a"))
    found = sharding.slots(rows, 40, "id").toPandas()
    sizes = found["shard"].value_counts()
    assert len(sizes) == 40 and sizes.max() < 1.2 * sizes.min()
    moved = found[found["shard"] != found["grown_shard"]]
    assert (moved["grown_shard"] == 40).all() and 0.8 / 41 < len(moved) / 40_000 < 1.2 / 41


def test_slots_of_hot_and_many_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 50)
    rows = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, F.lit(9)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.slots(rows, 5)
    assert found.count() == 6_000
    by = found.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("n"), F.count("*").alias("m")).collect()
    assert all(r["a"] == 0 and r["b"] + 1 == r["n"] == r["m"] for r in by)


def draw(doc_id, text, seed) -> float:
    parts = [str(seed), "" if doc_id is None else str(doc_id), hashlib.md5((text or "").encode()).hexdigest()]
    return int(hashlib.md5("\x1f".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def poisson(u: float, rate: float) -> int:
    k, total = 0, math.exp(-rate)
    term = total
    while total <= u:
        k += 1
        term *= rate / k
        total += term
        if term < 1e-18 and k > rate:
            break
    return k


def test_copies_invert_the_poisson_distribution(docs, corpus, clashing, no_docs):
    weights = {"s0": 8.0, "s1": 0.5, "s2": 1.0, None: 2.0}
    found = mixing.replicate(clashing, weights, epochs=3.0, seed=11)
    assert found.columns == [c for c in clashing.columns if c != "copy"] + ["copy"]
    n = Counter(r[3] for r in corpus)
    mass = sum(weights.values())
    want = Counter()
    for r in corpus:
        rate = weights.get(r[3], 0.0) / mass * len(corpus) * 3 / n[r[3]]
        for c in range(poisson(draw(r[0], r[1], 11), rate) if rate else 0):
            want[(r[0], r[1], r[3], c + 1)] += 1
    assert Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in found.collect()) == want
    same = mixing.replicate(clashing, weights, epochs=3.0, seed=11, copy_col=None)
    assert same.columns == clashing.columns and same.count() == sum(want.values())
    assert mixing.replicate(no_docs).count() == 0


@pytest.mark.parametrize("rate", [0.01, 0.4, 1.0, 3.7, 60.0, 2500.0])
def test_rates_are_met(spark, rate):
    rows = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("x").alias("source"))
    copies = mixing.replicate(rows, {"x": 1.0}, epochs=rate).groupBy("doc_id").agg(F.max("copy").alias("k"), F.count("*").alias("n"))
    mean, spread, equal = copies.select(F.sum("k") / 4_000, F.stddev("k"), F.min(F.col("k") == F.col("n"))).first()
    assert abs(mean - rate) < 5 * math.sqrt(rate / 4_000) and equal
    if rate > 3:
        assert abs(spread / math.sqrt(rate) - 1) < 0.1


def test_tables_reach_the_last_bit(spark):
    table = mixing.tables(spark.createDataFrame([("a", 1, 0.3), ("b", 1, 5000.0), ("c", 1, 0.0)], "source string, n long, rate double")).collect()
    assert {r["source"] for r in table} == {"a", "b"}
    for r in table:
        assert r["cdf"] == sorted(r["cdf"]) and abs(r["cdf"][-1] - 1) < 1e-12 and r["cdf"][0] < 1


def test_target_weights(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").otherwise("c").alias("source"))
    found = Counter({r[0]: r[1] for r in mixing.replicate(rows, {"hot": 1, "b": 1, "c": 2}).groupBy("source").count().collect()})
    assert all(abs(found[s] / 30_000 - share) < 0.02 for s, share in (("hot", 0.25), ("b", 0.25), ("c", 0.5)))


def test_mixture_is_shuffled_globally(spark):
    rows = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("x").alias("source"))
    order = [r[0] for r in mixing.replicate(rows, epochs=1.0).select("doc_id").collect()]
    first = sorted(order[: len(order) // 10])
    assert 8_000 < sum(first) / len(first) < 12_000 and order != sorted(order)


TURNS = "conv_id long, turn long, role string, text string, n long, pos string"


def brute_chats(rows):
    convs = defaultdict(set)
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs[c].add((t, r, x))

    def digest(r, x):
        return hashlib.md5((("0" if r is None else "1" + r) + "\x1f" + ("0" if x is None else "1" + x)).encode()).hexdigest()

    lists = {}
    for c, turns in convs.items():
        order = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", digest(t[1], t[2])))
        lists[c] = [(r, x) for _, r, x in order]
    out = {}
    for c, turns in lists.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in lists.values())
        if not longer and c == min(k for k, o in lists.items() if o == turns):
            out[c] = turns
    return out


def test_snapshots_collapse(spark):
    rnd = random.Random(6)
    rows = []
    for c in range(60):
        base = [(t, "user" if t % 2 == 0 else "assistant", f"hello {t} {c % 7}") for t in range(rnd.randint(1, 9))]
        rows += [(c, t, r, x, 1, "p") for t, r, x in base]
    rows += [(100, t, "user", f"long {t}", 1, "p") for t in range(700)] + [(101, t, "user", f"long {t}", 1, "p") for t in range(699)]
    rows += [(102, 5 + t, "user", f"long {t}", 1, "p") for t in range(300)]  # other turn numbers, same turns
    rows += [(103, 0, None, "a", 1, "p"), (104, 0, "", "a", 1, "p"), (105, 0, None, None, 1, "p"), (106, 0, None, "", 1, "p"), (107, None, "user", "x", None, None), (107, 0, "user", "y", None, None)]
    rows += [(108, 0, "user", "tie a", 1, "p"), (108, 0, "user", "tie b", 1, "p"), (None, 0, "user", "nobody", 1, "p"), (None, None, None, None, None, None)]
    rows += [rows[0], rows[0], rows[5]]
    found = chat.render(spark.createDataFrame(rows, TURNS).repartition(4)).collect()
    want = brute_chats(rows)
    assert {r["conv_id"] for r in found} == set(want)
    for c, turns in want.items():
        parts = sorted((r["segment"], r["chat"], r["n_turns"]) for r in found if r["conv_id"] == c)
        assert [p[0] for p in parts] == list(range(-(-len(turns) // 256))) and all(p[2] == len(turns) for p in parts)
        assert "".join(p[1] for p in parts) == "".join(f"<|{r or ''}|>\n{x or ''}\n<|end|>\n" for r, x in turns)
    assert chat.render(spark.createDataFrame([], TURNS)).count() == 0


def test_language_of_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, model = langid.train(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").select("text", "lang").collect()
    right = sum(names[int(langid.log_likelihood(model, r["text"]).argmax())] == r["lang"] for r in rows)
    assert names == ["de", "en", "es", "fr"] and right / len(rows) > 0.95


def test_evidence_is_fused(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {lang: [r["text"] for r in docs.where((F.col("lang") == lang) & (F.length("text") > 500)).limit(40).collect()] for lang in ("de", "fr")}
    page = "<html lang='{}'><head><script>the and of</script></head><body><nav>the the</nav><p>{}</p></body></html>".format
    rows = [(i, f"https://www.a{i % 4}.de/x", page("de", t)) for i, t in enumerate(by["de"])]
    rows += [(100 + i, f"https://b{i % 4}.fr", page("fr-FR", t)) for i, t in enumerate(by["fr"])]
    rows += [(200, "https://www.a0.de/y", "<p>1234</p>"), (201, "https://b0.fr/y", None), (202, None, "<html lang=de></html>"), (203, None, None), (None, "not a url", page("fr", by["fr"][0])), (204, "https://x.fr", ""), (204, "https://x.fr", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("old")).withColumn("score", F.lit("old"))
    found = langid.identify(pages, docs).collect()
    assert len(found) == len(rows)
    got = {r["page_id"]: r for r in found}
    assert all(got[i]["lang"] == "de" and got[i]["declared"] == "de" for i in range(len(by["de"])))
    assert all(got[100 + i]["lang"] == "fr" and got[100 + i]["declared"] == "fr" for i in range(len(by["fr"])))
    assert [got[k]["lang"] for k in (200, 201, 202, 204, None)] == ["de", "fr", "de", "fr", "fr"]
    assert got[200]["host"] == "www.a0.de" and got[203]["host"] is None and 0 < got[203]["probability"] <= 1
    assert langid.identify(pages.limit(0), docs).count() == 0
    nothing = langid.identify(pages, docs.limit(0))
    assert nothing.count() == len(rows) and nothing.where("lang is not null").count() == 0


def brute_posterior(pages, names, model):
    """Every formula of the module's docstring, page by page."""
    k = range(len(names))
    read = []
    for i, url, page in pages:
        score = langid.log_likelihood(model, langid.visible(page))
        soft = np.exp(score - score.max())
        host = langid.host_of(url)
        read.append((i, host, host.rpartition(".")[2] if host else None, langid.declared(page), score, soft / soft.sum()))

    def total(at, value):
        return sum((r[5] for r in read if value is not None and r[at] == value), np.zeros(len(names)))

    everything = sum(r[5] for r in read)
    out = []
    for i, host, suffix, mark, score, soft in read:
        less = lambda w: np.maximum(w - soft, 0)
        prior = (less(everything) + 1) / (everything.sum() - 1 + len(names))
        for at, value, weight in ((2, suffix, langid.SUFFIX_WEIGHT), (1, host, langid.HOST_WEIGHT)):
            w = less(total(at, value)) if value is not None else np.zeros(len(names))
            prior = (w + weight * prior) / (w.sum() + weight)
        log = score + np.log(prior)
        if mark is not None:
            w = less(total(3, mark))
            log = log + np.log((w + langid.DECLARED_WEIGHT * max(w.sum() / everything.sum(), 1e-6)) / (everything + langid.DECLARED_WEIGHT))
        p = np.exp(log - log.max())
        out.append((i, names[int(log.argmax())], float(1 / p.sum()), names[int(score.argmax())], mark, host))
    return sorted(out, key=repr)


def odd_pages():
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choice(["the house and the tree", "das haus und der baum", "la maison et le arbre", "x1 y2"]) for _ in range(rnd.randint(0, 12)))
    page = "<html {}><!-- {} --><p>{}</p><script>the the</script></html>".format
    rows = [(i, rnd.choice([f"https://h{i % 9}.{rnd.choice(['de', 'fr', 'com'])}/x", None, "no address"]), page(rnd.choice(["lang=en", "lang='de-AT'", "", 'LANG="FR"', "lang=zz"]), text(), text())) for i in range(120)]
    return rows + [(500, None, None), (501, "https://h1.de", ""), (501, "https://h1.de", ""), (None, "https://h2.fr", "<p>la maison")]


@pytest.mark.parametrize("at_once", [32, 2])
def test_posterior_by_hand(spark, monkeypatch, at_once):
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    docs = spark.createDataFrame([("the house and the tree " * 9, "en"), ("das haus und der baum " * 9, "de"), ("das haus " * 5, "de_CH"), ("la maison et le arbre " * 9, "FR-ca"), ("la casa y el arbol", " es "), ("", "it"), ("the end", ""), ("the end", None), (None, "en")], "text string, lang string")
    rows = odd_pages()
    names, model = langid.train(docs)
    assert names == ["de", "en", "es", "fr", "it"]
    found = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), docs).collect()
    want = brute_posterior(rows, names, model)
    got = sorted((tuple(r) for r in found), key=repr)
    assert [w[:2] + w[3:] for w in want] == [g[:2] + g[3:] for g in got]
    assert all(abs(w[2] - g[2]) < 2e-6 for w, g in zip(want, got, strict=True))


def test_many_languages(spark):
    word = lambda i: f"{'abcdefghij'[i // 12]}{'klmnopqrstuv'[i % 12]}{'wxyz'[i % 4]}q"
    docs = spark.createDataFrame([(f"{word(i)} " * 50, f"l{i:03d}") for i in range(120)], "text string, lang string")
    pages = spark.createDataFrame([(i, f"https://a.x{i}", f"<p>{(word(i) + ' ') * 20}") for i in range(0, 120, 10)], "page_id long, url string, html string")
    found = {r["page_id"]: r["lang"] for r in langid.identify(pages, docs).collect()}
    assert found == {i: f"l{i:03d}" for i in range(0, 120, 10)}


@pytest.mark.parametrize("broken", ["<meta content-language ", "<!-- ", "<script ", "<html ", "<", "</script ", "<meta content=", "<html lang", "<style></style ", "&lt", "<!---->", "<nav><script>"])
def test_a_megabyte_of_broken_markup_is_read_in_a_second(broken):
    page = broken * (1_000_000 // len(broken))
    began = time.process_time()
    langid.declared(page)
    langid.visible(page)
    assert time.process_time() - began < 3  # seconds; about one on a free machine


def test_shown_text_and_declarations_of_broken_pages():
    assert langid.visible("a <!-- b <p>c</p> <script>d</script> e").split() == ["a", "c", "e"]
    assert langid.visible("a <script>b <style>c</style> d").split() == ["a", "b", "d"] and langid.visible("a < b").split() == ["a", "<", "b"]
    assert langid.visible("x<nav>n</nav>y<NAV >n</Nav >z").split() == ["x", "y", "z"] and langid.visible(None) == ""
    assert langid.declared("<html><html lang=pt>") == "pt" and langid.declared("<html lang=pt") == "pt"
    assert langid.declared("<meta content=fr http-equiv=content-language>") is None
    assert langid.declared("<meta content=de content-language content='fr'>") == "fr" and langid.declared("<meta content-language><meta content-language content=IT>") == "it"


def test_features_and_markup():
    assert langid.visible("<p>a &amp; b<!-- c --><SCRIPT>x</SCRIPT ></p>").split() == ["a", "&", "b"]
    assert langid.declared('<HTML class="x" LANG="EN-us">') == "en" and langid.declared("<p>") is None
    assert langid.declared('<meta http-equiv="content-language" content="fr">') == "fr"
    assert langid.host_of("http://u:p@Ex.Ample.COM:80/a") == "ex.ample.com" and langid.host_of("x") is None


def test_pipeline_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    cursor = con.execute(corpus_pipeline.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    found = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]


def test_near_duplicates_stage_keeps_unlinked_rows_of_one_id(spark):
    rnd = random.Random(12)
    text = lambda: " ".join(f"v{rnd.randrange(900)}" for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    near = b.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, c, "en", "s"), (3, near, "en", "s"), (3, d, "en", None), (3, d, None, "t"), (3, d, None, "s"),
            (4, d, "a", "s"), (5, "", "x", "s"), (5, "", "x", "s"), (5, None, "x", "s"), (None, a, "x", "s"), (None, a, "x", "s"), (6, a, "x", "s"), (7, " \n ", "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("component", F.lit("old")).withColumn("digest", F.lit("old"))
    kept = sorted(map(repr, (tuple(r)[:4] for r in jaccard.keep_first(docs.repartition(4)).collect())))
    want = [rows[0], rows[1], rows[2], (3, d, None, "s"), *rows[8:13], rows[14]]
    assert kept == sorted(map(repr, want))


def test_pipeline_matches_sql_on_repeated_ids(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = base.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 3).when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("doc_id")))
    odd = odd.union(odd.where("doc_id % 5 = 1")).union(odd.where("doc_id % 5 = 2").withColumn("lang", F.lit(None).cast("string")))
    odd.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cte = corpus_pipeline.ORACLE_SQL[: corpus_pipeline.ORACLE_SQL.index("q3 AS")].rstrip().rstrip(",")
    want = con.execute(cte + " SELECT doc_id, text, lang, source, n_chars FROM q2").fetchall()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, str(tmp_path)), "test-stage")
    assert sorted(map(repr, map(tuple, docs.select("doc_id", "text", "lang", "source", "n_chars").collect()))) == sorted(map(repr, want))
    assert 0 < len(want) < odd.count()


def test_stages_on_odd_rows(spark, docs, clashing, no_docs):
    d = "/root/testdata/sf0.001"
    for table in (clashing, docs.limit(0), docs.where("text is null"), docs.where("doc_id is null"), docs.union(docs)):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            before = rows.columns
            rows = corpus_pipeline.common.stored(stage(spark, rows, d), "test-stage")
            assert set(rows.columns) == set(before) | ({"shard"} if name == "shard" else set())
