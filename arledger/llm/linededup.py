"""Line deduplication by two Bloom filters (operator 6).

1. Every task puts the hashes of its documents' line keys (each once per document) into two Bloom filters,
   *once seen* and *twice seen*. Filters are merged part by part: once = or; twice = or, or a bit that is set in
   both once-filters. Compressed, a task's filters are about as large as the number of its lines, whatever
   the size of the whole filter.
2. Only the merged twice-filter goes to all tasks. Its size follows the amount of text, up to ``MOST_BITS``; past
   that, more unrepeated lines are suspected, and the result stays exact. Documents with no suspected line
   are finished there; of the others the suspects' digests and the text are stored.
3. Only suspects are shuffled: least and greatest document per digest, combined before the shuffle, confirm a
   repeat and choose its first occurrence; the digests to drop then meet their documents.

A key is the line without white space at both ends, A-Z lower-cased; keys of fewer than ``LEAST_CHARS`` code
points never count. Confirmed is by 128-bit BLAKE2b digests of the keys.

Defined results: a null or empty text is one empty line; a null id is no document: its row keeps all lines and
others' lines don't count it; rows of one id are one document (its repeated lines are no repeat of others);
the same line again in the document that holds it first stays; an empty table gives an empty one. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_CHARS = 10
#: Bytes of a usual line, filter bits for it, hash functions, and the least and most address bits of a filter.
LINE_BYTES, BITS_PER_LINE, HASHES, LEAST_BITS, MOST_BITS = 128, 12, 3, 20, 30
#: Bytes of a filter that are merged and sent as one part.
PART = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Lines:
    """The line keys of one chunk of texts: text, number in the text, begin and end in ``data``, hash."""

    def __init__(self, texts: list[bytes | None]):
        raw, begins = common.lined_up(texts)
        self.data = _LOWER[raw]
        feeds = np.flatnonzero(raw == 10)
        line_begin = np.concatenate(([0], feeds[:-1] + 1))
        text = np.searchsorted(begins, line_begin, "right") - 1
        self.n_lines = np.bincount(text, minlength=len(texts))
        number = np.arange(len(feeds)) - (np.cumsum(self.n_lines) - self.n_lines)[text]
        solid = np.flatnonzero(~common.WHITE[raw])
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        a, b = np.searchsorted(solid, line_begin), np.searchsorted(solid, feeds)
        some = np.flatnonzero(b > a)
        start, end = solid[a[some]], solid[b[some] - 1] + 1
        long = chars[end] - chars[start] >= LEAST_CHARS
        some, self.start, self.end = some[long], start[long], end[long]
        self.text, self.number = text[some], number[some]
        self.hash = common.string_hashes(self.data, self.start, self.end)

    def only(self, which: np.ndarray) -> None:
        self.text, self.number, self.start, self.end, self.hash = (x[which] for x in (self.text, self.number, self.start, self.end, self.hash))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit numbers of each hash, one row per hash function."""
    step = common.mix64(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) >> np.uint64(64 - bits) for i in range(HASHES)])


class Filters:
    """Once-seen and twice-seen Bloom filters."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        at = np.sort(positions(hashes, self.bits), axis=None)
        first = np.flatnonzero(np.diff(at, prepend=at[0] + np.uint64(1)))
        again = np.diff(np.append(first, len(at))) > 1
        at = at[first]
        byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        again |= (self.once[byte] & bit) > 0
        self._set(self.once, byte, bit)
        self._set(self.twice, byte[again], bit[again])

    @staticmethod
    def _set(filt: np.ndarray, byte: np.ndarray, bit: np.ndarray) -> None:
        if len(byte):
            first = np.flatnonzero(np.diff(byte, prepend=-1))
            filt[byte[first]] |= np.bitwise_or.reduceat(bit, first)

    def parts(self):
        """(number, once, twice) of the parts in use, compressed."""
        for k in range(-(-len(self.once) // PART)):
            once = self.once[k * PART : (k + 1) * PART]
            if once.any():
                yield k, zlib.compress(once.tobytes(), 1), zlib.compress(self.twice[k * PART : (k + 1) * PART].tobytes(), 1)


def seen_twice(filt: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in positions(hashes, bits):
        out &= (filt[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def filter_bits(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(size // LINE_BYTES * BITS_PER_LINE).bit_length()))


def twice_filter(source: DataFrame, bits: int) -> np.ndarray:
    """The merged twice-seen filter of the line keys of ``source`` (id, text)."""

    def build(batches):
        filters = Filters(bits)
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            texts = common.byte_texts(known.column(1))
            for a, b in common.chunks(texts):
                lines = Lines(texts[a:b])
                own = common.mix64(lines.hash + lines.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                filters.add(lines.hash[np.unique(own, return_index=True)[1]])
        for part in filters.parts():
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "once", "twice"), part, strict=True))])

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
                if row["part"] in held:
                    old, old_twice = held[row["part"]]
                    once, twice = old | once, old_twice | twice | (old & once)
                held[row["part"]] = once, twice
        for part, (_, twice) in held.items():
            yield pa.RecordBatch.from_pylist([{"part": part, "twice": zlib.compress(twice.tobytes(), 1)}])

    parts = source.mapInArrow(build, "part long, once binary, twice binary")
    merged = parts.repartition("part").mapInArrow(merge, "part long, twice binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in merged.collect():  # at most 2 ** bits / 8 bytes in all
        part = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        out[row["part"] * PART : row["part"] * PART + len(part)] = part
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_sha256 and, if asked for, the kept text."""
    source = common.pick(docs, id=id_col, text=text_col)
    bits = filter_bits(docs, text_col)
    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(source, bits))
    kind = source.schema["id"].dataType.simpleString()

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, known = common.byte_texts(batch.column(1)), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            n_lines, keys, numbers = [], [[] for _ in texts], [[] for _ in texts]
            for a, b in common.chunks(texts):
                lines = Lines(texts[a:b])
                lines.only(known[a + lines.text])
                lines.only(seen_twice(twice.value, bits, lines.hash))
                n_lines.append(lines.n_lines)
                raw = lines.data.tobytes()
                for t, n, s, e in zip((a + lines.text).tolist(), lines.number.tolist(), lines.start.tolist(), lines.end.tolist(), strict=True):
                    keys[t].append(digest(raw[s:e]))
                    numbers[t].append(n)
            done = pa.array([not k for k in keys])
            sha = pa.array([None if k else hashlib.sha256(t or b"").hexdigest() for t, k in zip(texts, keys, strict=True)], pa.string())
            columns = [batch.column(0), batch.column(1) if with_text else pa.array([None if d else t for d, t in zip(done.to_pylist(), texts, strict=True)], pa.binary()).cast(pa.string())]
            columns += [pa.array(np.concatenate(n_lines)), sha, pa.array(keys, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text", "n_lines", "sha", "keys", "numbers"])

    probed = common.stored(source.mapInArrow(probe, f"id {kind}, text string, n_lines long, sha string, keys array<binary>, numbers array<int>"), "line-probes")
    suspects = probed.where("sha is null").select("id", F.explode(F.array_distinct("keys")).alias("key"))
    repeats = common.stored(suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first"), "line-repeats")
    drops = suspects.join(repeats, "key").where("id > first").groupBy("id").agg(F.collect_set("key").alias("drop"))
    open_docs = probed.where("sha is null").join(common.stored(drops, "line-drops"), "id", "left").select("id", "text", "n_lines", "keys", "numbers", "drop")

    def finish(batches):
        for batch in batches:
            texts, n_dropped, kept = common.byte_texts(batch.column(1)), [], []
            for t, keys, numbers, drop in zip(texts, *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                gone = set(drop or ())
                away = {n for k, n in zip(keys, numbers, strict=True) if k in gone}
                n_dropped.append(len(away))
                kept.append(b"\n".join([x for n, x in enumerate(t.split(b"\n")) if n not in away]) if away else t)
            sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            text = pa.array(kept if with_text else [None] * len(kept), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_dropped, pa.int64()), sha, text], ["id", "n_lines", "n_dropped", "sha", "text"])

    finished = open_docs.mapInArrow(finish, f"id {kind}, n_lines long, n_dropped long, sha string, text string")
    whole = probed.where("sha is not null").select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "sha", F.coalesce("text", F.lit("")).alias("text"))
    out = whole.unionByName(finished)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("sha").alias("kept_sha256"), *(["text"] if with_text else []))
