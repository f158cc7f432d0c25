"""Filter interaction audit by truth-table survival words (operator 12).

Five filters judge every document. Its 32-bit survival word has bit S set if the document passes all filters of
the subset S (A is bit 0 of S, E bit 4). How often each bit is set, per part and label, is counted by carry-save
adders: three words of one weight become a sum word and a carry word of twice the weight, until two words a
weight are left. The 32 subset survivors of a part answer every question about every order of the filters:
what a step keeps, removes or repeats, what only one filter fails, and the Shapley value of a filter.

Filters (a document fails): A under 100 words; B 100 * distinct words < 80 * words; C 100 * [A-Z] characters > 10 *
code points; D any of ``#$%&*|``; E text identical to that of a smaller id, anywhere in the table. Texts are told
apart by 128-bit digests; only (id, part, digest, verdicts) is stored and shuffled, never a text. A copied text's
least id comes from a pre-aggregated minimum and is stored, so Spark can split the rows of a hot text in the join.

Defined results: a null text is empty (fails A; a copy of other empty texts); a null part is the empty string; a
null id has no smaller id and no label; of repeated rows with one id none is a copy of the other, each counts; an
id has quality (toxic) 1 if any of its label rows says so; an empty table gives no part; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*|")] = True

#: Survival word of each set of failed filters: bit S is set if no filter of S is among them.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def verdicts(texts: list[bytes | None]) -> np.ndarray:
    """Of each text, the filters A to D that it fails, as bits 0 to 3."""
    data, begins = common.lined_up(texts)
    ids, words, _, used = common.word_table(data, common.WHITE[data], begins)
    pairs = np.unique(np.repeat(np.arange(len(texts)), words) * max(used, 1) + ids)
    distinct = np.bincount(pairs // max(used, 1), minlength=len(texts))
    points = common.per_text((data & 0xC0) != 0x80, begins) - 1  # without the line feed after each text
    capitals = common.per_text((data >= 65) & (data <= 90), begins)
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, common.per_text(SYMBOLS[data], begins) > 0)
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def popcounts(words: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Of each group, how many of its words have each of the 32 bits set (groups x 32): carry-save adders
    reduce all groups at once, three words of one weight to a sum and a carry."""
    out, weight = np.zeros((groups, 32), np.int64), 0
    while len(words):
        carried = [(group[:0], words[:0])]
        while True:
            by = np.argsort(group, kind="stable")
            group, words = group[by], words[by]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            size = np.diff(np.append(first, len(group)))
            whole = np.arange(len(group)) - np.repeat(first, size) < np.repeat(size - size % 3, size)
            if not whole.any():
                break
            a, b, c = words[whole].reshape(-1, 3).T
            of, half = group[whole][::3], a ^ b
            carried.append((of, (a & b) | (half & c)))
            group, words = np.concatenate((group[~whole], of)), np.concatenate((words[~whole], half ^ c))
        bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        np.add.at(out, group, bits.astype(np.int64) << weight)
        group, words, weight = np.concatenate([g for g, _ in carried]), np.concatenate([w for _, w in carried]), weight + 1
    return out


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, failed, good, toxic) of every document: its failed filters as bits, and its labels."""
    source = common.pick(docs, id=id_col, part=part_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = common.byte_texts(batch.column(2))
                failed = np.concatenate([verdicts(texts[a:b]) for a, b in common.chunks(texts)])
                digests = pa.array([hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(failed.astype(np.int32))], ["id", "part", "digest", "failed"])

    source = source.withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    marks = common.stored(source.mapInArrow(run, f"id {kind}, part string, digest binary, failed int"), "audit-marks")
    copied = marks.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = common.stored(copied.select("digest", "first"), "audit-copied")
    known = common.pick(labels, labelled="doc_id", quality="quality", toxic="toxic").where("labelled is not null").groupBy("labelled")
    known = known.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")).where("good or toxic")
    known = common.stored(known, "audit-labels")
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int") * F.lit(1 << FILTERS.index("E"))
    flagged = marks.join(copied, "digest", "left").select("id", "part", (F.col("failed") + late).alias("failed"))
    flagged = flagged.join(known, F.col("id") == F.col("labelled"), "left")
    return flagged.select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivors(marked: DataFrame) -> DataFrame:
    """(part, survivors): per part the 32 entries (subset, n, good, toxic), counts of the documents (all, labelled
    quality 1, labelled toxic 1) that pass every filter of the subset."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                parts = batch.column(0).dictionary_encode()
                label = batch.column(2).cast(pa.int8()).to_numpy() + 2 * batch.column(3).cast(pa.int8()).to_numpy()
                group = parts.indices.to_numpy().astype(np.int64) * 4 + label
                counts = popcounts(SURVIVAL[batch.column(1).to_numpy()], group, 4 * len(parts.dictionary))
                seen = np.unique(group)
                rows = pa.ListArray.from_arrays(np.arange(0, SUBSETS * len(seen) + 1, SUBSETS, dtype=np.int32), counts[seen].ravel())
                columns = [parts.dictionary.take(pa.array(seen // 4)), pa.array(seen % 2 == 1), pa.array(seen % 4 >= 2), rows]
                yield pa.RecordBatch.from_arrays(columns, ["part", "good", "toxic", "counts"])

    counted = marked.mapInArrow(run, "part string, good boolean, toxic boolean, counts array<long>")
    long = counted.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    sums = long.groupBy("part", "subset").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    return sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("survivors"))


def _shapley(bit: int) -> Column:
    """Documents that a filter removes, summed over all orders: every subset before it comes in |S|! (k - 1 - |S|)! orders."""
    n = lambda s: F.col("survivors")[s]["n"]
    others = [s for s in range(SUBSETS) if not s & bit]
    orders = lambda s: math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count())
    return sum(((n(s) - n(s | bit)) * F.lit(orders(s)) for s in others), F.lit(0).cast("long"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; every count is a long."""
    parts = survivors(judged(docs, labels, id_col, text_col, part_col))
    shapley = F.array(*[_shapley(1 << i) for i in range(len(FILTERS))])
    parts = parts.select("part", "survivors", shapley.alias("values"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.array(*map(F.lit, range(1, len(FILTERS) + 1)))).alias("step"))
    at = lambda k: F.ascii(F.substring("filter_order", k, 1)) - F.lit(ord(FILTERS[0]))
    bits = [F.when(F.col("step") > k, F.call_function("shiftleft", F.lit(1), at(k))).otherwise(0) for k in range(1, len(FILTERS))]
    steps = steps.withColumns({"before": sum(bits[1:], bits[0]), "index": F.ascii(F.expr("substring(filter_order, step, 1)")) - F.lit(ord(FILTERS[0]))})
    steps = steps.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("index")))
    all_of = SUBSETS - 1
    of = lambda subset, what: F.get("survivors", subset)[what]
    before, after, bit = F.col("before"), F.col("before") + F.col("bit"), F.col("bit")
    removed = of(before, "n") - of(after, "n")
    return steps.select(
        "part",
        "filter_order",
        "step",
        of(after, "n").alias("kept"),
        removed.alias("removed"),
        (of(F.lit(0), "n") - of(bit, "n") - removed).alias("redundant"),
        (of(F.lit(all_of) - bit, "n") - of(F.lit(all_of), "n")).alias("unique_fails"),
        (of(before, "good") - of(after, "good")).alias("good_lost"),
        (of(before, "toxic") - of(after, "toxic")).alias("toxic_lost"),
        F.get("values", F.col("index")).alias("shapley"),
    )
