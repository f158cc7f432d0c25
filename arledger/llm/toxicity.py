"""Toxicity by a factorization machine over hashed terms (operator 13).

A text's terms are its words and the stems of ``STEMS`` leading characters of its words, as 64-bit hashes; a term
is there or not, however often. The machine scores w0 + sum of w over the terms + sum of <v_i, v_j> over the pairs of
terms, so it learns that an insult beside the mention of a group is worse than the sum of the two.

1. A sample of at most ``SAMPLE`` labelled ids (least hashes first, whatever the label) is drawn among those that are
   not held out. That bounded table (ids and labels only) is broadcast, so no text is shuffled; the sample's texts
   are stored.
2. Each term of the sample is counted by label (grouped sums, combined in the tasks). The ``TERMS`` terms that are
   most over-represented in toxic texts, by at least ``LEAST_Z`` standard deviations, are the machine's inputs.
3. The sample's rows, now lists of a few input numbers, are fitted by AdaGrad in one task; the model is under a MB.
4. Every whole text of the table is scored, in numpy over all texts of a chunk, with nothing shuffled.

Learned from: the text and ``toxic`` of label rows whose crc32(id as text) mod ``FOLDS`` isn't 0. Labels, other columns
and ids are no inputs of a score.

Defined results: a null or empty text has no terms and gets the score of w0; equal texts get equal scores; a null id
is hashed as the empty string (held out); label rows without id or label teach nothing, an id with several labels is
toxic if one says so; repeated rows of a sampled id all count among the terms, and one of them teaches; without labels, or with one label only, w0 is the
smoothed share of toxic rows and no term counts; an empty table gives an empty one.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows that teach, terms that count, and how far a term must be over-represented.
SAMPLE, TERMS, LEAST_Z = 32_768, 8_192, 4.0
#: Every ``FOLDS``-th id (by checksum) is held out.
FOLDS = 5
#: Leading characters of a word that are terms of their own.
STEMS = (3, 4, 5, 6, 7)
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 12, 256, 0.1, 1e-4

#: Bytes of words: ASCII letters and digits, and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capital letters of Latin-1 in lower case (lengths stay)."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[latin] += 0x20
    return out


def word_terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text as (number of the text, number of the word) by text, and the hashes of each
    word's terms (words x kinds; a stem that a word is too short for is the word itself)."""
    data, begins = common.lined_up(texts)
    data = lowered(data)
    inside = WORD[data]
    ids, counts, starts, used = common.word_table(data, ~inside, begins)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1 + len(STEMS)), np.uint64)
    pairs = np.unique(np.repeat(np.arange(len(texts)), counts) * used + ids)
    one = np.empty(used, np.int64)
    one[ids] = np.arange(len(ids))
    start, end = starts[one], common.spans(inside)[1][one]  # an occurrence of each word of the chunk
    characters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(characters, start)
    kinds = [common.string_hashes(data, start, end)]
    for k in STEMS:
        stem_end = characters[np.minimum(first + k, len(characters) - 1)]
        hashed = common.mix64(common.string_hashes(data, start, np.minimum(stem_end, end)) ^ np.uint64(0x5851F42D4C957F2D))
        kinds.append(np.where(stem_end <= end, hashed, kinds[0]))
    return pairs // used, pairs % used, np.stack(kinds, axis=1)


def _distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, by text and value."""
    by = np.lexsort((value, text))
    text, value = text[by], value[by]
    new = (np.diff(text, prepend=-1) != 0) | np.concatenate((np.ones(min(len(value), 1), bool), value[1:] != value[:-1]))
    return text[new], value[new]


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text: (number of the text, hash of the term), by text."""
    text, word, kinds = word_terms(texts)
    return _distinct(np.repeat(text, kinds.shape[1]), kinds[word].ravel())


class Machine:
    """A fitted machine: sorted hashes of its input terms, w0, w and v."""

    def __init__(self, hashes: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.hashes, self.w0, self.w, self.v = hashes, w0, w, v

    def dumped(self) -> bytes:
        np.savez(out := io.BytesIO(), hashes=self.hashes, w0=self.w0, w=self.w, v=self.v)
        return out.getvalue()

    @classmethod
    def loaded(cls, blob: bytes) -> Machine:
        stored = np.load(io.BytesIO(blob))
        return cls(stored["hashes"], float(stored["w0"]), stored["w"], stored["v"])

    def inputs(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, number of the input) of the texts' terms that count."""
        text, word, kinds = word_terms(texts)
        if not len(self.hashes) or not len(word):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, kinds), len(self.hashes) - 1)
        known = self.hashes[at] == kinds
        some = known.any(axis=1)[word]  # few words have a term that counts
        text, word = text[some], word[some]
        mine = known[word]
        return _distinct(np.repeat(text, mine.sum(axis=1)), at[word][mine])

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        row, at = self.inputs(texts)
        return _sigmoid(_margins(row, at, len(texts), self.w0, self.w, self.v)[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _summed(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values of each row number; ``row`` rises."""
    out = np.zeros((rows, *values.shape[1:]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _margins(row: np.ndarray, at: np.ndarray, rows: int, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of the rows, and the sums of their factors: pairs come from (sum v)^2 - sum v^2."""
    mine = v[at]
    total = _summed(row, mine, rows)
    pairs = (total**2).sum(1) - _summed(row, (mine**2).sum(1), rows)
    return w0 + _summed(row, w[at], rows) + pairs / 2, total


def fit(row: np.ndarray, at: np.ndarray, label: np.ndarray, inputs: int, seed: int = 13) -> tuple[float, np.ndarray, np.ndarray]:
    """w0, w and v from rows given as (row, input) pairs by row, by AdaGrad on the logistic loss."""
    rows, rnd = len(label), np.random.default_rng(seed)
    share = (label.sum() + 0.5) / (rows + 2)
    w0, w, v = np.log(share / (1 - share)), np.zeros(inputs), rnd.normal(0, 0.05, (inputs, FACTORS))
    if not inputs or label.min(initial=1) == label.max(initial=0):
        return float(w0), w, v * 0
    g0, gw, gv = 1.0, np.full(inputs, 1e-2), np.full((inputs, FACTORS), 1e-2)
    begin = np.searchsorted(row, np.arange(rows + 1))
    for _ in range(EPOCHS):
        order = rnd.permutation(rows)
        for some in np.split(order, range(BATCH, rows, BATCH)):
            size = begin[some + 1] - begin[some]
            local = np.repeat(np.arange(len(some)), size)
            here = at[np.arange(size.sum()) + np.repeat(begin[some] - np.cumsum(size) + size, size)]
            margin, total = _margins(local, here, len(some), w0, w, v)
            slope = (_sigmoid(margin) - label[some]) / len(some)
            w0 -= RATE * slope.sum() / np.sqrt(g0 := g0 + slope.sum() ** 2)
            by = np.argsort(here, kind="stable")
            used, of = np.unique(here[by], return_inverse=True)
            push = slope[local[by]]
            dw = _summed(of, push, len(used)) + DECAY * w[used]
            dv = _summed(of, push[:, None] * (total[local[by]] - v[here[by]]), len(used)) + DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return float(w0), w, v


def _held_out(column):
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(FOLDS) == 0


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(id, text, toxic) of at most ``sample`` labelled ids that aren't held out, stored."""
    known = common.pick(labels, id="doc_id", toxic="toxic").where("id is not null and toxic is not null").where(~_held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    return common.stored(common.pick(docs, id=id_col, text=text_col).join(F.broadcast(drawn), "id"), "toxicity-sample")


def chosen_terms(sample: DataFrame, most: int) -> np.ndarray:
    """The sorted hashes of the terms that count."""

    def run(batches):
        for batch in batches:
            texts, label = common.byte_texts(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in common.chunks(texts):
                row, found = terms(texts[a:b])
                kinds, of = np.unique(found, return_inverse=True)
                toxic = np.bincount(of, label[a:b][row], len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(of, minlength=len(kinds))), pa.array(toxic)], ["term", "n", "toxic"])

    rows, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    if not 0 < bad < rows:
        return np.zeros(0, np.uint64)
    counts = sample.select("text", "toxic").mapInArrow(run, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    expected = F.col("n") * F.lit(bad / rows)
    z = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    best = counts.where("toxic > 1").select("term", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(most)
    return np.sort(np.array([r.term for r in best.collect()], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most_terms: int = TERMS) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows."""
    rows = sampled(docs, labels, id_col, text_col, sample)
    blank = Machine(chosen_terms(rows, most_terms), 0.0, np.zeros(0), np.zeros((0, FACTORS)))

    def listed(batches):
        for batch in batches:
            texts = common.byte_texts(batch.column(1))
            for a, b in common.chunks(texts):
                row, at = blank.inputs(texts[a:b])
                lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32), at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists], ["id", "toxic", "terms"])

    def fitted(batches):
        labels_, counts, inputs = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for batch in batches:  # lists stay in arrays: the sample is small there, but not as Python objects
            labels_.append(batch.column(0).to_numpy(zero_copy_only=False).astype(float))
            counts.append(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            inputs.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
        each, at = np.concatenate(counts), np.concatenate(inputs)
        row = np.repeat(np.arange(len(each), dtype=np.int32), each)
        w0, w, v = fit(row, at, np.concatenate(labels_), len(blank.hashes))
        yield pa.RecordBatch.from_arrays([pa.array([Machine(blank.hashes, w0, w, v).dumped()], pa.binary())], ["machine"])

    kind = rows.schema["id"].dataType.simpleString()
    lists = rows.mapInArrow(listed, f"id {kind}, toxic boolean, terms array<int>")
    lists = lists.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms"))
    lists = lists.repartition(1).sortWithinPartitions("id").select("toxic", "terms")
    found = lists.mapInArrow(fitted, "machine binary").first()
    return Machine.loaded(bytes(found.machine)) if found else Machine(blank.hashes, *fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    source = common.pick(docs, id=id_col, text=text_col)
    kind, blob = source.schema["id"].dataType.simpleString(), machine.dumped()

    def run(batches):
        model = Machine.loaded(blob)
        for batch in batches:
            if batch.num_rows:
                texts = common.byte_texts(batch.column(1))
                found = np.concatenate([model.scores(texts[a:b]) for a, b in common.chunks(texts)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "score"])

    scored = source.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), _held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels that aren't held out and score every document."""
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
