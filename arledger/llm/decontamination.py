"""Benchmark decontamination by Wu-Manber search (operator 2).

Texts are reduced to their words (A-Z lower-cased, everything else than letters and digits in ASCII taken as
a gap) with one space around each. A pattern is a window of ten consecutive item words, or a whole shorter
item, spaces included, so a byte match is a word match. For each class of pattern lengths, with m its shortest:

* block shift tables: for every hash of a block of eight bytes, how far the search may move when the block
  ends at its position (m - 7 if it lies in no pattern's first m bytes). Many segments of the text move at
  once, each by its own shift.
* suffix buckets: where the shift is 0, the block itself selects the patterns whose first m bytes end in it.
* direct comparison: first the patterns' first eight bytes, then all bytes.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES``, cut by a hash after its size is known;
with one block, documents are read once and never shuffled. Each block before the last is a pass of its own over the
documents, so only one block's tables are in memory; such a pass stores no text, only the hits of each different text
that has any, which the rows of the last pass meet by the text's digest.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; rows of
one item_id count as one item, a null item_id as the id ""; equal documents get equal results; an empty
benchmark hits nothing; an empty table gives an empty one. Other columns are not read by ``hits`` and carried
along untouched by ``keep_clean``. A byte 0xFF, which UTF-8 doesn't have, is read as 0xFE.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW_WORDS = 10
#: Most bytes of benchmark text in one block, bytes of a text segment that has its own cursor, and most
#: candidate pairs or bytes that are compared at a time.
BLOCK_BYTES, SEGMENT, AT_ONCE = 4 << 20, 512, 1 << 20
#: Pattern lengths are classed by these lower bounds, so that short items don't shorten the shifts of all.
CLASSES = (1, 8, 16, 32)
GAP, END = 0x20, 0xFF

_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else GAP for c in range(256))


def normal(texts: list[bytes | None]) -> np.ndarray:
    """Each text as " word word ... " and END."""
    joined = (b" \xff ".join([t.replace(b"\xff", b"\xfe") if t and b"\xff" in t else t or b"" for t in texts])).join((b" ", b" \xff"))
    data = np.frombuffer(joined.translate(_TO_WORDS), np.uint8)
    gap = data == GAP
    keep = np.ones(len(data), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return data[keep]


def word_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data[1:] < END) & (data[1:] != GAP) & (data[:-1] == GAP)) + 1


class Texts:
    """Normalised texts, their words, and their bytes eight at a time."""

    def __init__(self, texts: list[bytes | None]):
        self.data = normal(texts)
        self.ends = np.flatnonzero(self.data == END)
        self.words = word_starts(self.data)
        self.upto = np.searchsorted(self.words, self.ends)
        self.n_words = np.diff(self.upto, prepend=0)
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        self.eights = np.ndarray((len(self.data),), "<u8", padded, strides=(1,))


class Group:
    """Tables of the patterns of one length class."""

    def __init__(self, texts: Texts, start: np.ndarray, length: np.ndarray, pattern: np.ndarray):
        self.m = int(length.min())
        self.block = min(8, self.m)
        most = self.m - self.block + 1
        self.bits = min(22, max(12, int(len(start) * most).bit_length() + 2))
        shift = np.full(1 << self.bits, most, np.int16)
        for back in range(most - 1, -1, -1):  # smaller shifts overwrite larger ones
            shift[self.slot(self.ending(texts, start + self.m - 1 - back))] = back
        self.shift = shift
        suffix = self.ending(texts, start + self.m - 1)
        by = np.argsort(suffix, kind="stable")
        self.start, self.length, self.pattern = start[by], length[by], pattern[by]
        self.suffix, self.first = np.unique(suffix[by], return_index=True)
        self.prefix = self.beginning(texts, self.start)

    def beginning(self, texts: Texts, at: np.ndarray) -> np.ndarray:
        return texts.eights[at] << np.uint64(8 * (8 - self.block))

    def ending(self, texts: Texts, at: np.ndarray) -> np.ndarray:
        """The block that ends at each position."""
        return self.beginning(texts, at - (self.block - 1))

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and patterns (by their place in this group) whose suffix and prefix blocks agree."""
        n = len(texts.data)
        begin = np.arange(0, n, SEGMENT)
        stop = np.minimum(begin + SEGMENT + self.m - 1, n)
        cursor = begin + self.m - 1
        found, blocks = [], []
        while True:
            live = cursor < stop
            if not live.all():
                cursor, stop = cursor[live], stop[live]
            if not len(cursor):
                break
            block = self.ending(texts, cursor)
            step = self.shift[self.slot(block)]
            here = np.flatnonzero(step == 0)
            if len(here):
                found.append(cursor[here])
                blocks.append(block[here])
            cursor = cursor + np.maximum(step, 1)
        if not found:
            return
        at, block = np.concatenate(found) - (self.m - 1), np.concatenate(blocks)
        place = np.minimum(np.searchsorted(self.suffix, block), len(self.suffix) - 1)
        same = self.suffix[place] == block
        at, place = at[same], place[same]
        many = np.append(self.first, len(self.start))
        count = many[place + 1] - many[place]
        upto = np.cumsum(count)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, "right")))
            c = count[a:b]
            each = np.repeat(many[place[a:b]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            pos = np.repeat(at[a:b], c)
            alike = self.beginning(texts, pos) == self.prefix[each]
            yield pos[alike], each[alike]
            a = b


class Patterns:
    """One block of the benchmark: items (id, text) -> the windows' tables and the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW_WORDS):
        texts = Texts([t for _, t in items])
        self.data = texts.data
        first, last, owner = [], [], []
        for i, (a, b) in enumerate(zip(np.append(0, texts.upto[:-1]), texts.upto, strict=True)):
            if b > a:
                at = np.arange(a, max(a, b - window) + 1)
                first.append(at)
                last.append(np.minimum(at + window, b) - 1)
                owner.append(np.full(len(at), i))
        self.ids, self.groups = [x for x, _ in items], []
        if not first:
            return
        first, last, owner = map(np.concatenate, (first, last, owner))
        word_end = np.concatenate((texts.words[1:] - 1, [0]))
        word_end[texts.upto[texts.n_words > 0] - 1] = texts.ends[texts.n_words > 0] - 1
        start, length = texts.words[first] - 1, word_end[last] - texts.words[first] + 2
        raw = texts.data.tobytes()
        kinds: dict[bytes, int] = {}
        kind = np.fromiter((kinds.setdefault(raw[s : s + n], len(kinds)) for s, n in zip(start, length, strict=True)), np.int64, len(start))
        _, one = np.unique(kind, return_index=True)
        by = np.lexsort((owner, kind))
        self.owners, self.owner_at = owner[by], np.append(np.searchsorted(kind[by], np.arange(len(kinds))), len(by))
        self.n_words = (last - first + 1)[one]
        start, length = start[one], length[one]
        level = np.searchsorted(CLASSES, length, "right")
        for k in np.unique(level):
            mine = np.flatnonzero(level == k)
            self.groups.append(Group(texts, start[mine], length[mine], mine))

    def search(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: position in ``texts.data`` and number of the pattern."""
        places, patterns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in self.groups:
            for pos, each in g.candidates(texts):
                inside = pos + g.length[each] <= len(texts.data)
                pos, each = pos[inside], each[inside]
                upto, a = np.cumsum(g.length[each]), 0
                while a < len(pos):
                    b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, "right")))
                    n = g.length[each[a:b]]
                    begin = np.cumsum(n) - n
                    step = np.arange(n.sum()) - np.repeat(begin, n)
                    same = texts.data[np.repeat(pos[a:b], n) + step] == self.data[np.repeat(g.start[each[a:b]], n) + step]
                    whole = np.logical_and.reduceat(same, begin)
                    places.append(pos[a:b][whole])
                    patterns.append(g.pattern[each[a:b]][whole])
                    a = b
        return np.concatenate(places), np.concatenate(patterns)

    def found(self, raw: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: its number of words, the word ranges that are hit, the ids of the items found."""
        texts = Texts(raw)
        ranges: list[list[tuple[int, int]]] = [[] for _ in raw]
        items: list[set[str]] = [set() for _ in raw]
        pos, pattern = self.search(texts)
        if len(pos):
            doc = np.searchsorted(texts.ends, pos)
            word = np.searchsorted(texts.words, pos)
            step = np.zeros(len(texts.words) + 1, np.int64)
            np.add.at(step, word, 1)
            np.add.at(step, word + self.n_words[pattern], -1)
            hit = np.cumsum(step[:-1]) > 0
            for d, p in np.unique(np.stack((doc, pattern), 1), axis=0):
                items[d].update(self.ids[o] for o in self.owners[self.owner_at[p] : self.owner_at[p + 1]])
            for d in np.unique(doc):
                first = texts.upto[d] - texts.n_words[d]
                ranges[d] = [(int(a), int(b)) for a, b in zip(*common.spans(hit[first : texts.upto[d]]), strict=True)]
        return texts.n_words, ranges, items


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Broadcast]:
    """The benchmark's patterns in broadcasts of bounded size (one, if it has at most ``BLOCK_BYTES``)."""
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("i"), benchmark[text_col].alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        rows = part.collect()  # about BLOCK_BYTES by the count above
        yield benchmark.sparkSession.sparkContext.broadcast(Patterns([(r["i"], r["t"].encode()) for r in rows], window))


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """One row per document: id, n_words, spans (first word and end of each hit range, flat) and items (sorted ids)."""
    source = common.pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    tail = "n_words long, spans array<long>, items array<string>"

    def scan(patterns: Broadcast, whole: bool):
        """All rows with their digests, or only those with hits, without id."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                raw = common.byte_texts(batch.column(1))
                n_words, ranges, items = [], [], []
                for a, b in common.chunks(raw):
                    n, r, i = patterns.value.found(raw[a:b])
                    n_words.append(n)
                    ranges += r
                    items += i
                columns = [pa.array(np.concatenate(n_words)), pa.array([[x for r in rs for x in r] for rs in ranges], pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "digest", "n_words", "spans", "items"])
                yield out if whole else out.filter(pa.array([bool(r) for r in ranges])).select(["digest", "spans", "items"])

        return run

    texts, held, earlier = source.withColumn("digest", _digest(F.col("text"))), None, []
    for block in blocks(benchmark, item_col, item_text_col, window):
        if held is not None:
            found = texts.mapInArrow(scan(held, False), "digest binary, spans array<long>, items array<string>")
            earlier.append(common.stored(found.dropDuplicates(["digest"]), "wu-manber"))
            held.unpersist()
        held = block
    if not earlier:
        rows = source.withColumn("digest", F.lit(None).cast("binary")).mapInArrow(scan(held, True), f"id {kind}, digest binary, {tail}")
        return rows.drop("digest").withColumnRenamed("id", id_col)
    rows = common.stored(texts.mapInArrow(scan(held, True), f"id {kind}, digest binary, {tail}"), "wu-manber-last")
    more = functools.reduce(DataFrame.union, earlier).groupBy("digest").agg(F.collect_list("spans").alias("s"), F.collect_list("items").alias("i"))  # one entry a block

    def united(batches):
        for batch in batches:
            spans, items = [], []
            for own, ids, s, i in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                flat = [own, *(s or [])]
                spans.append([x for r in _union([(f[k], f[k + 1]) for f in flat for k in range(0, len(f), 2)]) for x in r])
                items.append(sorted({*ids, *(x for part in i or [] for x in part)}))
            columns = [pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "n_words", "spans", "items"])

    joined = rows.join(common.stored(more, "wu-manber-earlier"), "digest", "left").select("id", "n_words", "spans", "items", "s", "i")
    return joined.mapInArrow(united, f"id {kind}, {tail}").withColumnRenamed("id", id_col)


def _digest(text: Column) -> Column:
    """Equal texts have equal hits, so a text's MD5 stands for it between the passes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def digest(found: DataFrame) -> DataFrame:
    """``hits`` with n_hit, n_items, items_sha256 and contaminated in place of the lists."""
    hit = F.aggregate(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.element_at("spans", i + 1) - F.element_at("spans", i))
    hit = F.when(F.size("spans") > 0, hit).otherwise(F.lit(0).cast("long"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(found.columns[0], "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, with the columns of ``docs``."""
    at = docs.columns.index(text_col)

    def scan(patterns: Broadcast):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    raw = common.byte_texts(batch.column(at))
                    clean = [not r for a, b in common.chunks(raw) for r in patterns.value.found(raw[a:b])[1]]
                    yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    def dirty(patterns: Broadcast):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    raw = common.byte_texts(batch.column(0))
                    hit = [bool(r) for a, b in common.chunks(raw) for r in patterns.value.found(raw[a:b])[1]]
                    yield batch.select(["digest"]).filter(pa.array(hit, pa.bool_()))

        return run

    texts, held, earlier = common.pick(docs, text=text_col).withColumn("digest", _digest(F.col("text"))), None, []
    for block in blocks(benchmark, item_col, item_text_col, window):
        if held is not None:
            earlier.append(common.stored(texts.mapInArrow(dirty(held), "digest binary").distinct(), "wu-manber-dirty"))
            held.unpersist()
        held = block
    if earlier:
        gone = common.stored(functools.reduce(DataFrame.union, earlier).distinct().select(F.col("digest").alias("__gone")), "wu-manber-gone")
        docs = docs.join(gone, _digest(docs[text_col]) == F.col("__gone"), "left_anti")
    return docs.mapInArrow(scan(held), docs.schema)
