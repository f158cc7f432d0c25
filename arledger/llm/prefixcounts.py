"""Token counts by prefix dynamic programming (operator 8).

For a piece (BPE) model, the count of every prefix follows from shorter prefixes: exactly one vocabulary entry
that ends the prefix goes with the last token of the prefix before it (two tokens go together if encoding
their joined text gives just these two), and the count is that prefix's count plus one. A character that
no entry holds costs its UTF-8 bytes (byte fallback).

No entry of the model joins two *units*: a unit begins where spaces follow something else, and at a line feed.
So the table over a whole text is a running sum over its units, and the inner table of a unit is made once
for all its occurrences in a chunk, and those of many units go in step, position by position, in arrays. A long unit
(a script without spaces, encoded data) is cut further wherever no entry holds the two characters beside each other,
as no merge crosses such a place. Tested token pairs are remembered in a table of fixed size. ``token_counts`` takes the last entry of each table; ``prefix_tables`` stores all entries, which ``tokens_of_prefix`` and
``longest_prefix`` read to answer truncation and budget questions without encoding anything again.

Counts are those of the library's plain ``encode``: no begin or end token, names of control tokens in a text
are ordinary characters, nothing is truncated.

Defined results: a null or empty text has 0 tokens and 0 bytes; equal rows give equal rows; an empty table
gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import common

#: Units of more characters are cut; of longer parts, so many of about one length are worked on together; bits of the
#: number of token pairs that a worker remembers.
TOGETHER, CROWD, PAIR_BITS = 32, 128, 21
#: Pairs that are kept for units worked on alone, and positions that such a unit asks about at a time.
FEW, AHEAD = 1 << 18, 48
SPACE = "▁"
_OUTSIDE = -1
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.array([pow(int(_BASE), i, 1 << 64) for i in range(256)], np.uint64)


def _char(c: np.ndarray) -> np.ndarray:
    return common.mix64(c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _hash(chars: np.ndarray) -> int:
    h = 0
    for c in _char(chars).tolist():
        h = (h * int(_BASE) + c) & 0xFFFFFFFFFFFFFFFF
    return h


class Pieces:
    """A sentencepiece BPE model with byte fallback, dummy prefix and no other normalization."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule, kinds = model.normalizer_spec, type(model.pieces[0])
        self.vocabulary = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        singles = {p for p in self.vocabulary if len(p) == 1}
        plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not rule.precompiled_charsmap
        apart = all("\n" not in p and SPACE not in p.lstrip(SPACE) and singles.issuperset(p) for p in self.vocabulary)
        others = {p.type for p in model.pieces} - {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
        if not (plain and apart and model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not others):
            raise ValueError(f"{path} isn't a plain piece model: its units can't be counted apart")
        self.text = [p.piece for p in model.pieces]
        self.longest = max(map(len, self.vocabulary))
        #: Tested pairs by slot: 2 * (pair + 1) + whether the two go together, or 0. A new pair takes an old one's slot.
        self.pairs = np.zeros(1 << PAIR_BITS, np.int64)
        self.few: dict[tuple[int, int], bool] = {}
        letters = [np.frombuffer(p.encode("utf-32-le"), "<u4").astype(np.uint64) for p in self.vocabulary]
        self.beside = np.unique(np.concatenate([x[:-1] << np.uint64(32) | x[1:] for x in letters]))
        self.known = np.array([_hash(np.frombuffer(p.encode("utf-32-le"), "<u4")) for p in self.vocabulary], np.uint64)
        self.number = np.fromiter(self.vocabulary.values(), np.int64, len(self.vocabulary))
        self.slots, rest = [], np.arange(len(self.known))
        for bits in (20, 17, 17, 17):  # entries that meet in a slot go to the next, smaller table
            slot = self._slot(self.known[rest], len(self.slots), bits)
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = rest
            self.slots.append((bits, table))
            rest = rest[table[slot] != rest]
        if len(rest) or len(np.unique(self.known)) != len(self.known):
            raise ValueError("the vocabulary's hashes meet")
        while (self.slots[-1][1] < 0).all():
            self.slots.pop()

    @staticmethod
    def _slot(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) >> np.uint64(64 - bits)).astype(np.int64)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        for level, (bits, table) in enumerate(self.slots):
            at = table[self._slot(h, level, bits)]
            here = np.flatnonzero(at >= 0)
            here = here[self.known[at[here]] == h[here]]
            out[here] = self.number[at[here]]
        return out

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of a's and b's joined text is just a, b (a is outside: of b's text, just b)."""
        pair = (a + 1) * len(self.text) + b
        slot = (common.mix64(pair) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        known = self.pairs[slot]
        new = np.flatnonzero(known >> 1 != pair + 1)
        if len(new):
            _, one, back = np.unique(pair[new], return_index=True, return_inverse=True)
            x, y = a[new[one]].tolist(), b[new[one]].tolist()
            joined = ["\n" + ("" if i == _OUTSIDE else self.text[i]) + self.text[j] for i, j in zip(x, y, strict=True)]
            just = [[j] if i == _OUTSIDE else [i, j] for i, j in zip(x, y, strict=True)]
            found = self.library.encode(joined, num_threads=1)  # each begins with the dummy prefix and the line feed
            known[new] = (2 * (pair[new[one]] + 1) + np.array([f[2:] == j for f, j in zip(found, just, strict=True)]))[back]
            self.pairs[slot[new]] = known[new]
        return known & 1 == 1

    def prefixes(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the prefixes of units that each stand after another one: all rows back to back
        (from the empty prefix on), and where each row begins."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(lens + 1) - (lens + 1)
        out = np.zeros(int((lens + 1).sum()), np.int64)
        short = np.flatnonzero(lens <= TOGETHER)
        short = short[np.argsort(lens[short], kind="stable")]
        if len(short):
            self._in_step([units[i] for i in short], lens[short], begin[short], out)
        long = np.flatnonzero(lens > TOGETHER)
        if len(long):
            at = np.repeat(begin[long] + 1 - (np.cumsum(lens[long]) - lens[long]), lens[long]) + np.arange(lens[long].sum())
            out[at] = self._cut([units[i] for i in long], lens[long])
        return out, begin

    def _cut(self, units: list[str], lens: np.ndarray) -> np.ndarray:
        """Token counts of the prefixes of long units (without the empty ones), back to back, from those of the
        parts that no entry joins."""
        joined = "".join(units)
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
        pairs = chars[:-1] << np.uint64(32) | chars[1:]
        place = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        first = np.concatenate(([True], self.beside[place] != pairs))
        starts_unit = np.zeros(len(chars), bool)
        starts_unit[np.cumsum(lens) - lens] = True
        part = np.flatnonzero(first | starts_unit)
        size = np.diff(np.append(part, len(chars)))
        number: dict[str, int] = {}
        of = np.fromiter((number.setdefault(joined[a : a + n], len(number)) for a, n in zip(part.tolist(), size.tolist(), strict=True)), np.int64, len(part))
        inner, begin = self._parts(list(number))
        total = inner[begin[of] + size]
        before = np.cumsum(total) - total
        of_unit = np.cumsum(starts_unit[part]) - 1
        before -= before[np.flatnonzero(starts_unit[part])][of_unit]
        inside = np.arange(len(chars)) - np.repeat(part, size) + 1
        return np.repeat(before, size) + inner[np.repeat(begin[of], size) + inside]

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``prefixes`` for parts of any length: many of about one length go in step, the others alone."""
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(lens + 1) - (lens + 1)
        out = np.zeros(int((lens + 1).sum()), np.int64)
        sizes = np.where(lens <= TOGETHER, 0, np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
        for kind in np.unique(sizes):
            some = np.flatnonzero(sizes == kind)
            if kind and len(some) < CROWD:
                for i in some:
                    out[begin[i] : begin[i] + lens[i] + 1] = self._alone(parts[i])
            else:
                some = some[np.argsort(lens[some], kind="stable")]
                self._in_step([parts[i] for i in some], lens[some], begin[some], out)
        return out, begin

    def _ends(self, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries in a unit, by where they end and, longest first: end, start, token."""
        chars = np.frombuffer(unit.encode("utf-32-le"), "<u4")
        upto = np.zeros(len(chars) + 1, np.uint64)
        for i, c in enumerate(_char(chars).tolist()):
            upto[i + 1] = (int(upto[i]) * int(_BASE) + c) & 0xFFFFFFFFFFFFFFFF
        found = []
        for size in range(1, min(self.longest, len(unit)) + 1):
            token = self.tokens(upto[size:] - upto[:-size] * _POWERS[size])
            at = np.flatnonzero(token >= 0)
            found.append((at + size, at, token[at]))
        end, start, token = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((start, end))
        return end[by], start[by], token[by]

    def _alone(self, unit: str) -> list[int]:
        """The table of one long unit. The entries in it are found in arrays; pairs that aren't known yet are asked about
        for the next ``AHEAD`` positions together."""
        end, start, token = self._ends(unit)
        first = np.searchsorted(end, np.arange(len(unit) + 2)).tolist()
        starts, tokens = start.tolist(), token.tolist()
        count, last = [0] * (len(unit) + 1), [_OUTSIDE] * (len(unit) + 1)
        for at in range(1, len(unit) + 1):
            for k in range(first[at], first[at + 1]):
                pair = (last[starts[k]], tokens[k])
                if pair not in self.few:
                    self._ask_ahead(pair, at, first, starts, tokens, last)
                if self.few[pair]:
                    count[at], last[at] = count[starts[k]] + 1, tokens[k]
                    break
            else:
                count[at] = count[at - 1] + len(unit[at - 1].encode())
        return count

    def _ask_ahead(self, pair: tuple[int, int], at: int, first: list[int], starts: list[int], tokens: list[int], last: list[int]) -> None:
        """Ask about ``pair`` and all pairs that the next positions may need."""
        if len(self.few) >= FEW:
            self.few.clear()
        stop = min(at + AHEAD, len(first) - 2)
        wanted = {pair}
        for k in range(first[at], first[stop + 1]):
            s = starts[k]
            before = {last[s]} if s < at else {*tokens[first[s] : first[s + 1]], _OUTSIDE}
            wanted |= {(b, tokens[k]) for b in before}
        new = [p for p in wanted if p not in self.few]
        known = self.together(np.array([a for a, _ in new]), np.array([b for _, b in new]))
        self.few.update(zip(new, known.tolist(), strict=True))

    def _in_step(self, units: list[str], lens: np.ndarray, begin: np.ndarray, out: np.ndarray) -> None:
        """The tables of units that are sorted by length, one position of all at a time."""
        n, most = len(units), int(lens[-1])
        chars = np.zeros((most, n), np.uint32)
        of, at = np.repeat(np.arange(n), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        chars[at, of] = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        upto = np.zeros((most + 1, n), np.uint64)
        count, last = np.zeros((most + 1, n), np.int32), np.full((most + 1, n), _OUTSIDE, np.int32)
        for end in range(1, most + 1):
            first = int(np.searchsorted(lens, end))
            char = chars[end - 1, first:]
            upto[end, first:] = upto[end - 1, first:] * _BASE + _char(char)
            live = np.arange(first, n)
            for size in range(min(end, self.longest), 0, -1):
                start = end - size
                token = self.tokens(upto[end, live] - upto[start, live] * _POWERS[size])
                able = np.flatnonzero(token >= 0)
                able = able[self.together(last[start, live[able]].astype(np.int64), token[able])]
                row = live[able]
                count[end, row], last[end, row] = count[start, row] + 1, token[able]
                live = np.delete(live, able)
                if not len(live):
                    break
            char = chars[end - 1, live]
            count[end, live] = count[end - 1, live] + 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
            out[begin[first:] + end] = count[end, first:]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def units(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of the texts, each with its dummy prefix: the number of each unit, the different units, units per text."""
    texts = [t.replace(SPACE.encode(), b" ") if t and SPACE.encode() in t else t for t in texts]
    data = np.frombuffer(b"".join([b" " + t for t in texts if t]), np.uint8)
    lens = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
    begins = np.cumsum(lens) - lens
    if not len(data):
        return np.zeros(0, np.int64), [], np.zeros(len(texts), np.int64)
    cut = data == 10
    cut[1:] |= (data[1:] == 32) & (data[:-1] != 32)
    cut[begins[lens > 0]] = True
    at = np.flatnonzero(cut)
    offsets = np.append(at, len(data))
    array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return array.indices.to_numpy(zero_copy_only=False), array.dictionary.to_pylist(), np.searchsorted(at, begins + lens) - np.searchsorted(at, begins)


def _inner(model: Pieces, different: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return model.prefixes([u.decode().replace(" ", SPACE) for u in different])


def counts(model: Pieces, texts: list[bytes | None]) -> np.ndarray:
    """The last entry of each text's table."""
    number, different, per_text = units(texts)
    inner, begin = _inner(model, different)
    total = inner[np.append(begin, len(inner))[1:] - 1]
    running = np.concatenate(([0], np.cumsum(total[number])))
    end = np.cumsum(per_text)
    return running[end] - running[end - per_text]


def table(model: Pieces, text: str) -> np.ndarray:
    """Token counts of text[:0], text[:1], ... text."""
    number, different, _ = units([text.encode()])
    inner, begin = _inner(model, different)
    rows = np.split(inner, begin[1:])
    out, base = [np.zeros(1, np.int64)], 0
    for n in number:
        out.append(base + rows[n][1:])
        base += int(rows[n][-1])
    whole = np.concatenate(out)  # the dummy prefix is one more character at the front
    return np.concatenate(([0], whole[2:])) if text else whole


def packed(counts_: np.ndarray) -> bytes:
    """A table as compressed 32-bit steps."""
    return zlib.compress(np.diff(counts_, prepend=0).astype("<i4").tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), "<i4"))


def token_counts(docs: DataFrame, model_path: str, most_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. Narrow: nothing is shuffled."""
    source = common.pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            if batch.num_rows:
                texts = common.byte_texts(batch.column(1))
                n = np.concatenate([counts(model, texts[a:b]) for a, b in common.chunks(texts)])
                size = pa.array([len(t) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > most_tokens)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def prefix_tables(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and prefix_counts, the packed table of all its prefixes."""
    source = common.pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            tables = [packed(table(model, t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.binary())], ["id", "prefix_counts"])

    return source.mapInArrow(run, f"id {kind}, prefix_counts binary").withColumnRenamed("id", id_col)


def tokens_of_prefix(prefix_counts: Column, characters: Column) -> Column:
    """Tokens of the first so many characters (of the whole text, if it has fewer)."""

    @pandas_udf("long")
    def look(blob, n):
        return blob.combine(n, lambda b, k: int((t := unpacked(b))[min(max(int(k), 0), len(t) - 1)]))

    return look(prefix_counts, characters)


def longest_prefix(prefix_counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix with at most so many tokens."""

    @pandas_udf("long")
    def look(blob, n):
        return blob.combine(n, lambda b, k: int(np.flatnonzero(unpacked(b) <= max(int(k), 0))[-1]))

    return look(prefix_counts, F.coalesce(budget, F.lit(0)))
