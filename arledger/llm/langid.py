"""Language ID by Bayesian evidence fusion (operator 5).

Four pieces of evidence on a page's language are combined by Bayes' rule:

* its text: likelihood of its hashed 4-byte letter sequences under models counted over all labelled documents,
  tempered to the weight of at most ``TEXT_WEIGHT`` of them, as overlapping sequences aren't independent;
* its declared markup language (the lang attribute of the html tag, else a content-language meta tag): the
  probability of the declaration given the language;
* its address suffix and its host, as a hierarchical prior: the languages' shares over all pages smooth the
  shares of the suffix, which smooth those of the host, the page's own part taken out at every level.

Declarations and priors are counted by grouped aggregation of the text posteriors (summed per task before the
shuffle); the tables are stored, and joined without a hint, so Spark may broadcast small ones and split a hot host.

Labels and declarations count by their lower-cased primary subtag (``en-US``, ``EN`` and ``en`` are one language). Any
number of languages works: the text is scored ``AT_ONCE`` languages at a time, and all later sums are functions of
arrays, whose plan doesn't grow with the languages. A page's markup is read in one pass forward, however broken
it is: a comment, tag or element that isn't closed is looked for once, not once per opening.

Defined results: without html the text says nothing, without url the prior is the shares over all pages,
without a declaration it is left out; ties go to the first language in order; a null label trains nothing; without
labelled documents the language is null; equal rows are judged alike; an empty table gives an empty one; only the
named columns are read; an empty label trains nothing.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the hash of a letter sequence; count added to each; sequences that a text counts for at most.
HASH_BITS, ADDED, TEXT_WEIGHT = 15, 0.5, 50.0
#: Pages that a level of the prior, or all declarations of a language, weigh against what they smooth with.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 5.0, 20.0, 10.0
#: Languages whose models (2 ** HASH_BITS numbers each) are held at a time.
AT_ONCE = 32

_OPENING = re.compile(r"<!--|<(script|style|nav|noscript|template)\b", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "nav", "noscript", "template")}
_TAG = re.compile(r"<[^>]*>")
_DECLARING = {kind: re.compile(rf"<{kind}\b", re.I) for kind in ("html", "meta")}
_LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,8})", re.I)
_CONTENT = re.compile(r"\bcontent\s*=\s*[\"']?\s*([a-zA-Z]{2,8})", re.I)
_ABOUT_LANGUAGE = re.compile("content-language", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
#: Bytes of letters: those of ASCII, and all others than ASCII; the rest is a gap.
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def shown(page: str) -> str:
    """The page without comments, scripts, styles, templates and navigation."""
    parts, at, look, unclosed = [], 0, 0, set()
    while (found := _OPENING.search(page, look)) is not None:
        name = (found[1] or "").lower()
        look = found.end()
        if name in unclosed:
            continue
        if name:
            closing = _CLOSING[name].search(page, look)
            end = closing.end() if closing else -1
        else:
            end = page.find("-->", look) + 3
            end = end if end >= 3 else -1
        if end < 0:
            unclosed.add(name)
            continue
        parts.append(page[at : found.start()])
        at = look = end
    return " ".join([*parts, page[at:]])


def visible(page: str | None) -> str:
    """The text of a page that a reader sees: what is shown, without tags."""
    if not page:
        return ""
    text = shown(page)
    end = text.rfind(">") + 1  # no tag closes after it
    return entities.unescape(_TAG.sub(" ", text[:end]) + text[end:])


def _tags(page: str, kind: str) -> Iterator[str]:
    """The openings of one kind, each up to its end (an unclosed one: up to the end of the page)."""
    at = 0
    while (found := _DECLARING[kind].search(page, at)) is not None:
        at = page.find(">", found.end())
        at = len(page) if at < 0 else at
        yield page[found.end() : at]


def declared(page: str | None) -> str | None:
    """The primary subtag of the html tag's lang attribute, else of a content-language meta tag."""
    if not page:
        return None
    for tag in _tags(page, "html"):
        if found := _LANG.search(tag):
            return found[1].lower()
    for tag in _tags(page, "meta"):
        values = list(_CONTENT.finditer(tag))
        about = [m.end() for m in _ABOUT_LANGUAGE.finditer(tag) if values and m.end() <= values[-1].start()]
        if about:
            return next(v[1] for v in values if v.start() >= about[-1]).lower()
    return None


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url) if url else None
    return found[1].lower().rstrip(".") or None if found else None


def features(text: str) -> np.ndarray:
    """Hashes of the 4-byte sequences of the letters, words set apart by one space."""
    words = text.lower().encode().translate(_LETTERS).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32) if words else np.zeros(0, np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.int64)
    four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    return ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def primary(label: Column) -> Column:
    """The lower-cased primary subtag of a language label; null if it is empty."""
    subtag = F.lower(F.trim(F.split(F.trim(label.cast("string")), "[-_]")[0]))
    return F.when(subtag != "", subtag)


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, hash, n) of the letter sequences of all labelled documents, stored."""
    source = common.pick(docs, text=text_col, lang=lang_col).where("text is not null").select("text", primary(F.col("lang")).alias("lang")).where("lang is not null")

    def count(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    found.setdefault(lang, []).append(features(text.as_py()))
                for lang, hashes in found.items():
                    used, n = np.unique(np.concatenate(hashes), return_counts=True)
                    # a language whose documents have no letters is known all the same
                    used, n = (used, n) if len(used) else (np.zeros(1, np.int64), np.zeros(1, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(n)], ["lang", "hash", "n"])

    counts = source.mapInArrow(count, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))
    return common.stored(counts, "language-counts")


def model_of(counts: DataFrame, names: list[str]) -> np.ndarray:
    """Log-probabilities of the hashes under each of (at most ``AT_ONCE``) languages, in order."""
    table = np.full((len(names), 1 << HASH_BITS), ADDED)
    got = counts.where(F.col("lang").isin(*names)).toPandas()  # at most 2 ** HASH_BITS rows a language
    table[np.searchsorted(names, got["lang"].to_numpy(str)), got["hash"].to_numpy(np.int64)] += got["n"].to_numpy()
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def languages(counts: DataFrame) -> list[str]:
    """The languages in order."""
    return sorted(r["lang"] for r in counts.select("lang").distinct().collect())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order and their model (for so many as fit into memory)."""
    counts = counted(docs, text_col, lang_col)
    names = languages(counts)
    return names, model_of(counts, names) if names else np.zeros((0, 1 << HASH_BITS), np.float32)


def log_likelihood(model: np.ndarray, text: str) -> np.ndarray:
    found = features(text)
    if not len(found):
        return np.zeros(len(model))
    return model[:, found].sum(1, dtype=np.float64) * min(1.0, TEXT_WEIGHT / len(found))


def scored(pages: DataFrame, model: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, key, host, suffix, declared, score): log-likelihoods of the text under the languages of ``model``. Equal
    pages have one ``key``."""
    source = common.pick(pages, id=id_col, url=url_col, html=html_col)
    kind = source.schema["id"].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            urls = batch.column(1).to_pylist()
            hosts = [host_of(u) for u in urls]
            marks, scores, keys = [], [], []
            for url, page in zip(urls, batch.column(2), strict=True):
                page = page.as_py()
                marks.append(declared(page))
                scores.append(log_likelihood(shared.value, visible(page)))
                keys.append(hashlib.blake2b(repr((url, page)).encode(), digest_size=16).digest())
            suffix = [h.rpartition(".")[2] if h else None for h in hosts]
            columns = [pa.array(x, pa.string()) for x in (hosts, suffix, marks)] + [pa.array([s.tolist() for s in scores], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *columns], ["id", "key", "host", "suffix", "declared", "score"])

    return source.mapInArrow(run, f"id {kind}, key binary, host string, suffix string, declared string, score array<double>")


def read_pages(pages: DataFrame, counts: DataFrame, names: list[str], id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, host, suffix, declared, score, soft): log-likelihoods of the text under all languages, and posteriors from
    it alone, stored. Beyond ``AT_ONCE`` languages, the scores of equal pages are found once per block of languages
    and joined by the pages' keys."""
    blocks = [names[i : i + AT_ONCE] for i in range(0, len(names), AT_ONCE)]
    read = common.stored(scored(pages, model_of(counts, blocks[0]), id_col, url_col, html_col), "language-pages")
    for block in blocks[1:]:
        more = scored(pages, model_of(counts, block), id_col, url_col, html_col).groupBy("key").agg(F.max("score").alias("more"))
        joined = read.join(common.stored(more, "language-block"), "key").withColumn("score", F.concat("score", "more")).drop("more")
        read = common.stored(joined, "language-pages")
    mass = F.transform("score", lambda x: F.exp(x - F.array_max("score")))
    return read.drop("key").withColumn("mass", mass).withColumn("soft", F.transform("mass", lambda x: x / _sum("mass"))).drop("mass")


def _sum(column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + x)


def _smoothed(column: str, base: str, n: str, weight: float) -> Column:
    """Shares of the sums ``column``, of total ``n``, with those of ``base`` added at a weight."""
    return F.zip_with(column, base, lambda w, b: (w + F.lit(weight) * b) / (F.col(n) + F.lit(weight)))


def _per_language(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and w: the sums of ``soft`` by language (combined in the tasks before they are shuffled)."""
    known = rows.where(" and ".join(f"{x} is not null" for x in keys)) if keys else rows
    long = known.select(*keys, F.posexplode("soft").alias("i", "p")).groupBy(*keys, "i").agg(F.sum("p").alias("p"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"])  # one entry a language
    return common.stored(long.groupBy(*keys).agg(listed.alias("w")), "language-" + "-".join(keys))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per page: id, lang, probability (6 digits), text_lang (by its text alone), declared, host."""
    counts = counted(docs, text_col, lang_col)
    names = languages(counts)
    if not names:
        return common.pick(pages, id=id_col).select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))])
    read = read_pages(pages, counts, names, id_col, url_col, html_col)
    overall = _per_language(read).first()
    total = overall["w"] if overall else [0.0] * len(names)  # one number a language
    marks, suffixes, hosts = (_per_language(read, *keys) for keys in (("declared",), ("suffix",), ("host", "suffix")))
    totals, none = F.array(*[F.lit(float(t)) for t in total]), F.array_repeat(F.lit(0.0), len(names))

    def less(column):
        """The sums of a group without the page itself (sums are rounded, so not below 0)."""
        return F.zip_with(F.coalesce(column, none), "soft", lambda w, p: F.greatest(w - p, F.lit(0.0)))

    rows = read.join(marks.withColumnRenamed("w", "wm"), "declared", "left").join(suffixes.withColumnRenamed("w", "ws"), "suffix", "left")
    rows = rows.join(hosts.select(F.col("host"), F.col("w").alias("wh")), "host", "left")
    rows = rows.withColumns({"wm": less(F.col("wm")), "ws": less(F.col("ws")), "wh": less(F.col("wh")), "all": less(totals)})
    n_all = float(sum(total))
    rows = rows.withColumn("prior", F.transform("all", lambda x: (x + 1.0) / F.lit(n_all - 1.0 + len(names))))
    for column, weight in (("ws", SUFFIX_WEIGHT), ("wh", HOST_WEIGHT)):
        rows = rows.withColumn("n", _sum(column)).withColumn("prior", _smoothed(column, "prior", "n", weight))
    marked = F.greatest(_sum("wm") / F.lit(max(n_all, 1e-300)), F.lit(1e-6))
    rows = rows.withColumn("marked", marked)
    fits = F.zip_with("wm", totals, lambda w, t: F.log((w + F.lit(DECLARED_WEIGHT) * F.col("marked")) / (t + F.lit(DECLARED_WEIGHT))))
    rows = rows.withColumn("fits", F.when(F.col("declared").isNull(), none).otherwise(fits))
    known = F.zip_with(F.zip_with("score", "fits", lambda s, f: s + f), "prior", lambda s, p: s + F.log(p))
    rows = rows.withColumn("sum", known).withColumn("top", F.array_max("sum"))
    rows = rows.withColumn("mass", F.aggregate("sum", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    listed = F.array(*[F.lit(n) for n in names])

    def first_best(column):
        return F.element_at(listed, F.array_position(column, F.array_max(column)).cast("int"))

    return rows.select(F.col("id").alias(id_col), first_best(F.col("sum")).alias("lang"), F.round(1.0 / F.col("mass"), 6).alias("probability"), first_best(F.col("score")).alias("text_lang"), "declared", "host")
